"""Substring dedup over words by recompression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, back, dropped, held, hexdigest, mix, read, small, union_length, with_keys, word_hashes
from .repeats import NONE_HOT, Hot, Prefix, asked_of, compared, fetched, run_rows, runs, without

WINDOW = 35
ROUNDS, LEVELS = 5, (5, 3, 0)  # rounds of naming, and those after which symbols can be keys
FAR = 1 << 40
COMMON = U64(1 << 63)  # is added to keys that are not hot, so that they come first


class Symbols:
    """A level: names, the words [s, e) that each stands for, and the words [cl, cr) that fix that this symbol is there."""

    def __init__(self, h: np.ndarray, doc: np.ndarray):
        self.name, self.doc, at = h, doc, np.arange(len(h))
        self.s, self.e, self.cl, self.cr = at, at + 1, at, at + 1

    def next(self) -> np.ndarray:
        """True where the next symbol is of the same document."""
        return np.append(self.doc[1:] == self.doc[:-1], False)

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """The contexts of the symbol before and the one after; out of reach at a document's ends, as there a window can't tell what is beyond."""
        on = self.next()
        left = np.where(np.append(False, on[:-1]), np.append(0, self.cl[:-1]), -FAR)
        right = np.where(on, np.append(self.cr[1:], 0), FAR)
        return left, right

    def keep(self, first: np.ndarray, name: np.ndarray) -> None:
        """Join the symbols from each `first` up to the next one."""
        last = np.append(first[1:], len(self.name)) - 1
        self.cl, self.cr = np.minimum.reduceat(self.cl, first), np.maximum.reduceat(self.cr, first)
        self.name, self.doc, self.s, self.e = name, self.doc[first], self.s[first], self.e[last]

    def name_runs(self) -> None:
        """A maximal run of one symbol gets a name from the symbol and its length; both neighbours fix where it ends."""
        if not len(self.name):
            return
        left, right = self.around()
        self.cl, self.cr = np.minimum(self.cl, left), np.maximum(self.cr, right)
        same = np.append(False, (self.name[1:] == self.name[:-1]) & self.next()[:-1])
        first = np.flatnonzero(~same)
        k = np.diff(first, append=len(self.name)).astype(U64)
        with np.errstate(over="ignore"):
            name = np.where(k > 1, mix(self.name[first] * U64(0xFF51AFD7ED558CCD) + k), self.name[first])
        self.keep(first, name)

    def name_pairs(self, turn: int) -> None:
        """A fair bit of each name, drawn anew each turn, puts it left or right; a left one and a right one after it become one symbol, named by both."""
        if not len(self.name):
            return
        with np.errstate(over="ignore"):
            is_left = (mix(self.name + U64(turn) * U64(0xC2B2AE3D27D4EB4F)) & U64(1)).astype(bool)
        on = self.next()
        head = is_left & on & ~np.append(is_left[1:], True)
        tail = np.append(False, head[:-1])
        left, right = self.around()
        alone = ~head & ~tail
        self.cl = np.where(alone & ~is_left, np.minimum(self.cl, left), self.cl)
        self.cr = np.where(alone & is_left, np.maximum(self.cr, right), self.cr)
        first = np.flatnonzero(~tail)
        with np.errstate(over="ignore"):
            joined = mix(self.name * U64(0x87C37B91114253D5) + np.append(self.name[1:], U64(0)) * U64(0x4CF5AD432745937F) + U64(turn))
        self.keep(first, np.where(head, joined, self.name)[first])


def keys(h: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, hot: Hot = NONE_HOT) -> np.ndarray:
    """For the window at each place the symbol that the window itself fixes: one that is not hot if there is any, then of the highest level, the longest, and the one with the
    largest name."""
    n, top = len(h), width.bit_length()
    best = np.zeros(n, U64)
    levels, x = {0: Symbols(h, doc)}, Symbols(h, doc)
    x.name_runs()
    for turn in range(1, ROUNDS + 1):
        x.name_pairs(turn)
        if turn in LEVELS:
            y = levels[turn] = Symbols.__new__(Symbols)
            y.__dict__ |= x.__dict__
    for level in LEVELS:
        x = levels[level]
        lo, hi = np.maximum(x.cr - width, start[x.doc]), np.minimum(x.cl, end[x.doc] - width)
        ok = np.flatnonzero(lo <= hi)
        lo, hi = lo[ok], hi[ok]
        rank = COMMON | (U64(level + 1) << U64(60)) | (np.minimum(x.e[ok] - x.s[ok], 255).astype(U64) << U64(52)) | (x.name[ok] >> U64(12))
        rank[hot(rank)] ^= COMMON
        size = np.log2(hi - lo + 1).astype(np.int64)
        tables = [np.zeros(n, U64) for _ in range(top + 1)]
        for k in range(top + 1):
            if len(p := np.flatnonzero(size == k)):
                np.maximum.at(tables[k], lo[p], rank[p])
                np.maximum.at(tables[k], hi[p] - (1 << k) + 1, rank[p])
        for k in range(top, 0, -1):
            half = 1 << (k - 1)
            np.maximum(tables[k - 1], tables[k], out=tables[k - 1])
            np.maximum(tables[k - 1][half:], tables[k][:-half], out=tables[k - 1][half:])
        best = np.maximum(best, tables[0])
        if level and not (best[: max(0, n - width + 1)] < COMMON).any():
            break
    return best


def word_runs(texts: list[bytes], width: int, hot: Hot = NONE_HOT):
    words = [t.split() for t in texts]
    words = [w if len(w) >= width else [] for w in words]
    many = np.array(list(map(len, words)), np.int64)
    h = word_hashes([w for ws in words for w in ws])
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none.view(U64), none, none, none.view(U64), none
    end = np.cumsum(many)
    start = end - many
    doc = np.repeat(np.arange(len(words)), many)
    prefix = Prefix(h)
    valid = np.arange(len(h)) <= (end - width)[doc]
    own = np.zeros(len(h), U64)
    own[: len(h) - width + 1] = prefix.windows(width)
    key = keys(h, doc, start, end, width, hot)
    first, n = runs(key, valid, doc, own)
    return doc[first], key[first], first - start[doc[first]], n, prefix.range(first, first + n + width - 1), 0 * first


def repeated_words(docs: DataFrame, width: int = WINDOW, texts: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, n_words, n_removed, kept_sha256 and, if `texts`, kept (the words that stay, joined by one space), held by Spark's cache.

    A word goes if a window of `width` consecutive words that covers it has a word sequence that also starts anywhere else, in the same document or another. Words are
    separated by ASCII white space and unchanged; windows are judged on the input.

    Recompression names runs and pairs of words, round after round, by hashes of what they consist of: equal texts get equal names everywhere without a table of names.
    With a symbol goes the stretch of words that fixes it, so it is known which symbols any occurrence of a window must show. The longest of these is the window's key.
    Windows that share a key in Spark are compared, by a hash of the whole run of windows first, then window by window.

    A null text has no words. Rows that share a doc_id are documents of their own, so equal rows repeat each other. A null doc_id is returned as null. Empty tables give
    no rows. A group of copies costs in proportion to its size: no pairs are formed. Other columns are not read.
    """
    d = with_keys(docs)
    x = compared(run_rows(d, lambda texts, hot: word_runs(texts, width, hot), every=True), "rec-rows", held)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            for k in range(b.num_rows):
                own = Prefix(word_hashes(b.column(2)[k].as_py().encode().split())).windows(width)
                for at in range(0, len(b.column(3)[k]), 2000):  # a long document has many
                    asked = asked_of(b.column(3)[k], at, 2000)
                    n = asked["n"].astype(np.int64)
                    i = np.repeat(asked["i0"] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                    m = len(i)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked["key"], n)), pa.array(own[i].view(np.int64)), pa.array(np.full(m, b.column(0)[k].as_py())), pa.array(np.full(m, b.column(1)[k].as_py())), pa.array(i.astype(np.int32)), pa.array(np.repeat(asked["same"], n))], ["key", "fp", "_d", "_o", "i", "same"])

    ask = fetched(d, x.filter("mixed and first"), ["key", "i0", "n", "same"])
    from pyspark.sql import Window as W

    each = ask.mapInArrow(windows, "key long, fp long, _d long, _o long, i int, same boolean").withColumn("many", F.count("*").over(W.partitionBy("key", "fp"))).filter("many > 1 and not same")
    gone = x.filter("key is null or same").select("_d", "_o", F.col("i0").alias("a"), (F.col("i0") + F.col("n") + (width - 1)).alias("b")).unionByName(each.select("_d", "_o", F.col("i").alias("a"), (F.col("i") + width).alias("b")))
    gone = held(gone, "rec-gone", rows=512)
    dropped(x)

    def cut(text: bytes, a: np.ndarray, b: np.ndarray) -> tuple:
        words = text.split()
        out = union_length(a, b, len(words)) if len(a) else np.zeros(len(words), bool)
        kept = b" ".join([words[k] for k in np.flatnonzero(~out)] if len(a) else words)
        return len(words), int(out.sum()), hexdigest(kept), *([kept.decode()] if texts else [])

    return back(without(d, gone, cut, "n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts, held))


def op4_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(read(spark, sf_dir, "documents"), texts=False)
