"""LM scoring by the marginal likelihood of a subword lattice."""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, back, batches_of, dropped, mix, most_frequent, read, saved, small, with_keys
from .packing import tokenizer_file

ROUNDS = 2
WORD_BATCH = 100_000  # words in an Arrow batch
SMOOTH = 0.1
TOP_WORDS, TOP_BYTES = 400_000, 48  # the broadcast dictionary: at most so many words of at most so many bytes,
TOP_LONG, LONG_BYTES = 4000, 2048  # and so many longer ones of at most so many bytes: below 30 MB
VECTOR_BYTES = 64  # longer words go through the scalar recursion
B, FINAL = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary(path: str) -> tuple[list[bytes], list[bool]]:
    """Pieces of a word-end vocabulary file as bytes, and whether each ends a word, in the file's order of ids. All single bytes are among them in both forms."""
    letters = byte_letters()
    vocab = sorted(json.load(open(path, encoding="utf-8"))["model"]["vocab"].items(), key=lambda x: x[1])
    pieces = {}
    for s, _ in vocab:
        final = s.endswith("</w>") and len(s) > 4
        s = s[:-4] if final else s
        if s and all(c in letters for c in s):
            pieces.setdefault((bytes(letters[c] for c in s), final), None)
    for b in range(256):
        pieces.setdefault((bytes([b]), False), None)
        pieces.setdefault((bytes([b]), True), None)
    return [p for p, _ in pieces], [f for _, f in pieces]


class Lattice:
    """All segmentations of a word into pieces, the last one of them final; log10 scores weight the pieces."""

    def __init__(self, pieces: list[bytes], final: list[bool]):
        self.pieces, self.final = pieces, final
        self.longest = min(VECTOR_BYTES, max(map(len, pieces)))
        self.index = {(p, f): k for k, (p, f) in enumerate(zip(pieces, final, strict=True))}
        self.scores = -np.log(np.arange(1, len(pieces) + 1) + 2.7)  # the order of ids as existing scores, until others are set
        self.scores -= np.logaddexp.reduce(self.scores)
        self.power = np.ones(VECTOR_BYTES + 1, U64)
        with np.errstate(over="ignore"):
            for k in range(VECTOR_BYTES):
                self.power[k + 1] = self.power[k] * B
        self.size = 1 << 20
        self.table, self.keys, self.probes = np.full(self.size, -1, np.int32), np.zeros(self.size, U64), 1
        for k, (p, f) in enumerate(zip(pieces, final, strict=True)):
            if len(p) > VECTOR_BYTES:
                continue
            h = self.prefixes(np.frombuffer(p, np.uint8)[None])[0, -1:]
            h = self.mark(h, f)[0]
            at, n = int(h >> U64(44)), 1
            while self.table[at] >= 0:
                at, n = (at + 1) % self.size, n + 1
            self.table[at], self.keys[at], self.probes = k, h, max(self.probes, n)

    def prefixes(self, m: np.ndarray) -> np.ndarray:
        out = np.zeros((len(m), m.shape[1] + 1), U64)
        with np.errstate(over="ignore"):
            for k in range(m.shape[1]):
                out[:, k + 1] = out[:, k] * B + (m[:, k].astype(U64) + U64(1))
        return out

    def mark(self, h: np.ndarray, final: bool) -> np.ndarray:
        return mix(h ^ FINAL) if final else mix(h)

    def arc(self, prefix: np.ndarray, i: int, j: int) -> np.ndarray:
        """The piece from byte i to byte j of each word; -1 where there is none."""
        with np.errstate(over="ignore"):
            h = self.mark(prefix[:, j] - prefix[:, i] * self.power[j - i], j == prefix.shape[1] - 1)
        at = (h >> U64(44)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        for _ in range(self.probes):
            np.copyto(out, self.table[at], where=self.keys[at] == h)
            at = (at + 1) % self.size
        return out

    def by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        of = defaultdict(list)
        for k, w in enumerate(words):
            of[len(w)].append(k)
        for n, ks in of.items():
            if n <= VECTOR_BYTES:
                for a in range(0, len(ks), 20_000):
                    part = ks[a : a + 20_000]
                    yield np.array(part), np.frombuffer(b"".join([words[k] for k in part]), np.uint8).reshape(-1, n)

    def forward(self, m: np.ndarray) -> tuple[np.ndarray, dict]:
        n, prefix, arcs = m.shape[1], self.prefixes(m), {}
        alpha = np.full((n + 1, len(m)), -np.inf)
        alpha[0] = 0
        scores = np.append(self.scores, -np.inf)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                a = self.arc(prefix, i, j)
                if (a >= 0).any():
                    arcs[i, j] = a
                    np.logaddexp(alpha[j], alpha[i] + scores[a], out=alpha[j])
        return alpha, arcs

    def scalar(self, w: bytes) -> tuple[np.ndarray, list]:
        n, longest, arcs = len(w), max(map(len, self.pieces)) if not hasattr(self, "most") else self.most, []
        self.most = longest
        alpha = np.full(n + 1, -np.inf)
        alpha[0] = 0
        for j in range(1, n + 1):
            for i in range(max(0, j - longest), j):
                k = self.index.get((w[i:j], j == n))
                if k is not None:
                    arcs.append((i, j, k))
                    alpha[j] = np.logaddexp(alpha[j], alpha[i] + self.scores[k])
        return alpha, arcs

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of the marginal probability of each word, over all its segmentations."""
        out = np.zeros(len(words))
        for ks, m in self.by_length(words):
            out[ks] = self.forward(m)[0][-1]
        for k, w in enumerate(words):
            if len(w) > VECTOR_BYTES:
                out[k] = self.scalar(w)[0][-1]
        return out / math.log(10)

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, over all segmentations of the words, each word counted so often."""
        total, scores = np.zeros(len(self.pieces)), np.append(self.scores, -np.inf)
        for ks, m in self.by_length(words):
            alpha, arcs = self.forward(m)
            n, c = m.shape[1], counts[ks]
            beta = np.full((n + 1, len(m)), -np.inf)
            beta[n] = 0
            for i, j in sorted(arcs, reverse=True):
                np.logaddexp(beta[i], beta[j] + scores[arcs[i, j]], out=beta[i])
            for (i, j), a in arcs.items():
                with np.errstate(invalid="ignore"):
                    total += np.bincount(np.maximum(a, 0), np.where(a >= 0, c * np.exp(np.minimum(0, alpha[i] + scores[a] + beta[j] - alpha[n])), 0), len(total))
        for k, w in enumerate(words):
            if len(w) > VECTOR_BYTES:
                alpha, arcs = self.scalar(w)
                beta = np.full(len(w) + 1, -np.inf)
                beta[-1] = 0
                for i, j, p in sorted(arcs, reverse=True):
                    beta[i] = np.logaddexp(beta[i], beta[j] + self.scores[p])
                for i, j, p in arcs:
                    total[p] += counts[k] * np.exp(min(0.0, alpha[i] + self.scores[p] + beta[j] - alpha[-1]))
        return total


def counted(d: DataFrame) -> DataFrame:
    """(word, c): every word of the documents with its count in the training ones; a task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        seen: set = set()

        def rows():
            words = [*held, *(w for w in seen if w not in held)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([held.get(w, 0) for w in words], pa.int64())], ["word", "c"])

        for b in small(batches):
            for text, out in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                (seen if out else held).update(text.lower().split())
            if len(held) + len(seen) > 400_000:
                yield rows()
                held.clear()
                seen.clear()
        if held or seen:
            yield rows()

    return d.select("text", "held_out").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train(words: DataFrame, lattice: Lattice, rounds: int) -> None:
    """Expectation maximization of the piece scores over all distinct training words, as pieces stand for what is left of a word's count after discounting, the same for
    each word. What comes to the driver is one number for each piece."""
    sc = words.sparkSession.sparkContext
    for _ in range(rounds):
        given = sc.broadcast(lattice)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(given.value.pieces))
            for b in batches:
                total += given.value.expected(b.column(0).to_pylist(), np.ones(b.num_rows))
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "e"])

        e = np.zeros(len(lattice.pieces))
        with batches_of(words.sparkSession, WORD_BATCH):  # words are worked on by length, many at a time
            found = words.filter("c > 0").mapInArrow(run, "k long, e double").groupBy("k").agg(F.sum("e")).collect()
        for k, x in found:
            e[k] = x
        lattice.scores = np.log((e + SMOOTH) / (e.sum() + SMOOTH * len(e)))
        given.destroy()


def lattice_scores(docs: DataFrame, vocabulary_path: str, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words, A-Z lower-cased, and an end. Held out is a document whose crc32 of its doc_id as text is divisible by 10 (of null: held out); the others train.
    The model draws at each place the end or a word. A word's lattice has an arc for it as a whole, if training documents hold it, weighing its count less a discount
    (absolute discounting, from how many words occur once and twice), and its sequences of pieces of an existing subword vocabulary, the last one marked as a word's
    end, which share what the discount leaves. The probability is the sum over all segmentations, by forward recursion in logarithms; probabilities of all words sum to
    one. Pieces start with scores by their rank in the vocabulary; `rounds` of expectation maximization fit them to all distinct training words. Any byte is a piece in
    both forms, so every text has a probability. base_score is the add-0.1 unigram of
    words. Words are counted in all documents and scored once each; the most frequent ones (TOP_WORDS of at most TOP_BYTES bytes, TOP_LONG longer ones of at
    most LONG_BYTES: a bound on the broadcast) meet documents in place, the others by a join on the word, so that no frequent word goes to one task; Spark splits the
    skewed rows of one that is longer still.

    A null text is empty: one end. Rows that share a doc_id are documents of their own. An empty table gives no rows; columns beyond doc_id and text are not read.
    """
    spark = docs.sparkSession
    out = F.when(F.col("_o") < 0, F.lit(0)).otherwise(F.crc32(F.col("_d").cast("string"))) % 10 == 0
    d = with_keys(docs).withColumn("held_out", out)
    words = saved(counted(d).repartition(4 * spark.sparkContext.defaultParallelism), "lat-words", rows=1000)  # all cores fit the pieces
    ends = d.filter("not held_out").count()
    n, v = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    once, twice = words.agg(F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    cut = max(0.1, once / (once + 2 * twice)) if once else 0.5
    held, left = n, math.log(cut * v / n) if n else 0.0  # the log probability that a word is drawn in pieces
    n, v = n + ends, v + (ends > 0)
    lattice = Lattice(*vocabulary(vocabulary_path))
    train(words, lattice, rounds)
    p_end = math.log10((ends + SMOOTH) / (n + 2 * SMOOTH))
    go_on = math.log10(1 - (ends + SMOOTH) / (n + 2 * SMOOTH))
    low = n + 0.1 * (v + 1)
    given = spark.sparkContext.broadcast(lattice)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws, c = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - cut, 0) / max(held, 1))
            lp = np.logaddexp(whole, given.value.log10(ws) * math.log(10) + left) / math.log(10) + go_on
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.log10((c + 0.1) / low)), pa.array(lp)], ["word", "c", "base", "lp"])

    table = saved(words.mapInArrow(score, "word binary, c long, base double, lp double"), "lat-table", rows=WORD_BATCH)
    dropped(words)
    long = table.filter((F.length("word") > TOP_BYTES) & (F.length("word") <= LONG_BYTES))
    top = most_frequent(table.filter(F.length("word") <= TOP_BYTES), TOP_WORDS).unionByName(most_frequent(long, TOP_LONG)).toArrow()
    frequent = spark.sparkContext.broadcast((top.column(0).to_pylist(), np.stack([top.column(k).to_numpy().astype(float) for k in (1, 2, 3)], 1)))
    first = np.array([ends > 0, math.log10((ends + 0.1) / low), p_end])  # of the end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["_d", "_o", "word", "n", "known", "base", "lp"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        index = {w: k for k, w in enumerate(frequent.value[0])}
        values = np.concatenate([frequent.value[1], np.zeros((1, 3))])
        values[:, 0] = values[:, 0] > 0
        for b in small(batches):
            ids, os = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            ws = [t.lower().split() for t in b.column(2).cast(pa.binary()).to_pylist()]
            many = np.array(list(map(len, ws)), np.int64)
            every = [w for x in ws for w in x]
            got = np.fromiter((index.get(w, -1) for w in every), np.int64, len(every))
            of = np.repeat(np.arange(len(ws)), many)
            sums = [np.bincount(of, values[got, k], len(ws)) + first[k] for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([ids, os, [None] * len(ws), many + 1, sums[0].astype(np.int64), sums[1], sums[2]], kinds, strict=True)], names)
            rare = np.flatnonzero(got < 0)
            for a in range(0, len(rare), 50_000):
                part = rare[a : a + 50_000]
                none = pa.nulls(len(part), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[of[part]]), pa.array(os[of[part]]), pa.array([every[k] for k in part.tolist()], pa.binary()), none.cast(pa.int64()), none.cast(pa.int64()), none, none], names)

    x = saved(d.select("_d", "_o", "text").mapInArrow(run, "_d long, _o long, word binary, n long, known long, base double, lp double"), "lat-parts", rows=1000)
    rare = x.filter("word is not null").select("_d", "_o", "word").join(table, "word").select("_d", "_o", F.lit(0).cast("long").alias("n"), (F.col("c") > 0).cast("long").alias("known"), "base", "lp")
    total = x.filter("word is null").drop("word").unionByName(rare).groupBy("_d", "_o").agg(*(F.sum(c).alias(c) for c in ("n", "known", "base", "lp")))
    total = total.withColumn("held_out", out)
    return back(total.select("_d", "_o", "held_out", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lp").alias("score")))


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
