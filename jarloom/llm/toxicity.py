"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks."""

from __future__ import annotations

import itertools
import math
import re
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, in_use, read, saved, small

MOST_TOXIC, MOST_CLEAN = 1000, 2500  # labelled documents that are learned from, at most
ORDER, DECAY = 4, 0.6  # of the kernel: characters in a subsequence, weight of each place that it spans
FOLD = 40  # classes of characters
MARK = FOLD - 1  # stands before the first letter of a word
PIECE = 12  # a longer unit is cut into overlapping pieces of this length
LANDMARKS = 300
EXAMPLES, FREQUENT, OTHERS, MISTAKES, CANDIDATES = 2500, 400, 12_000, 4000, 600  # bounds of fit()
SENTENCE = re.compile(rb"[.!?\n]+\s|\n+")
REMEMBERED = 300_000
SINGLE = -1e30  # the value that stands for a token of one character


def code(text: str) -> bytes:
    """Letters and digits as classes behind MARK: a-z have their own, digits share one, others share the rest by code point. Nothing for a word without any."""
    out = [MARK]
    for c in text:
        k = ord(c)
        if 97 <= k <= 122:
            out.append(k - 97)
        elif 48 <= k <= 57:
            out.append(26)
        elif c.isalnum():
            out.append(27 + k % (MARK - 27))
    return bytes(out) if len(out) > 1 else b""


def pieces(unit: bytes) -> list[bytes]:
    """The whole of a short unit; overlapping pieces that cover a long one."""
    if len(unit) <= PIECE:
        return [unit]
    return [unit[a : a + PIECE] for a in range(0, len(unit) - PIECE + PIECE // 3, PIECE // 3)]


class Spans:
    """For units of one length: the subsequences of ORDER places, and their weights."""

    made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, n: int):
        if n not in cls.made:
            at = np.array(list(itertools.combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
            d = np.tril(DECAY ** np.subtract.outer(np.arange(n), np.arange(n)).clip(0), -1)
            cls.made[n] = at, DECAY ** (at[:, -1] - at[:, 0] + 1.0), d
        return cls.made[n]


def subsequences(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """units (count, length) to the subsequences' numbers, their weights, and each unit's norm in the kernel's space (gap-weighted subsequence kernel with itself)."""
    at, w, d = Spans.of(units.shape[1])
    ids = units[:, at[:, 0]] if len(at) else np.zeros((len(units), 0), np.int64)
    for k in range(1, ORDER):
        ids = ids * FOLD + (units[:, at[:, k]] if len(at) else 0)
    same = (units[:, :, None] == units[:, None, :]).astype(float)
    n, x = units.shape[1], same * DECAY**2
    for _ in range(ORDER - 1):
        x = (x.reshape(-1, n) @ d.T).reshape(-1, n, n).transpose(0, 2, 1)
        x = same * (x.reshape(-1, n) @ d.T).reshape(-1, n, n).transpose(0, 2, 1)
    return ids, w, np.sqrt(np.maximum(x.sum((1, 2)), 1e-30))


def by_length(units: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = np.array([len(u) for u in units])
    for length in np.unique(n):
        if length >= ORDER:
            which = np.flatnonzero(n == length)
            for a in range(0, len(which), 500):
                part = which[a : a + 500]
                yield part, np.frombuffer(b"".join([units[k] for k in part]), np.uint8).reshape(-1, length).astype(np.int64)


def kernel(units: list[bytes], marks: list[bytes]) -> np.ndarray:
    """Normalized gap-weighted kernel of units with landmarks: products of their weights, summed over the subsequences that both have. Only these are gone through."""
    found = [(which, *subsequences(m)) for which, m in by_length(marks)]
    ids = np.concatenate([np.zeros(0, np.int64), *(x.ravel() for _, x, _, _ in found)])
    mark = np.concatenate([np.zeros(0, np.int64), *(np.repeat(which, x.shape[1]) for which, x, _, _ in found)])
    weight = np.concatenate([np.zeros(0), *((w[None] / norm[:, None]).ravel() for _, _, w, norm in found)])
    order = np.argsort(ids, kind="stable")
    ids, mark, weight = ids[order], mark[order], weight[order]
    out = np.zeros((len(units), len(marks)), np.float32)
    for which, m in by_length(units):
        for a in range(0, len(which), 25):  # each of their subsequences may be in most of the landmarks
            own, w, norm = subsequences(m[a : a + 25])
            first = np.searchsorted(ids, own)
            many = np.searchsorted(ids, own, side="right") - first
            r, c = np.nonzero(many)
            n = many[r, c]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[r, c], n)
            sums = np.bincount(np.repeat(r, n) * len(marks) + mark[at], np.repeat(w[c], n) * weight[at], len(own) * len(marks))
            out[which[a : a + 25]] = sums.reshape(len(own), -1) / norm[:, None]
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 100.0) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps; the last column of x is 1, and its coefficient the bias."""
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(50):
        on = np.flatnonzero(y * np.concatenate([x[k : k + 1000].astype(float) @ w for k in range(0, len(x), 1000)]) < 1)
        left, right = ridge / c, np.zeros(x.shape[1])
        for k in range(0, len(on), 1000):  # a bounded copy at a time
            part = x[on[k : k + 1000]].astype(float)
            weighted = part * weight[on[k : k + 1000], None]
            left = left + weighted.T @ part
            right += weighted.T @ y[on[k : k + 1000]]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def units_of(sentence: bytes) -> list[bytes]:
    """The units of a sentence: words without marks, and runs of ORDER and more single characters joined. Words are separated by ASCII white space, here as in scoring."""
    out, run = [], b""
    for w in [code(x.decode(errors="ignore").lower()) for x in sentence.split()] + [b""] * 2:
        if len(w) == 2:
            run += w[1:] if run else w
            continue
        if len(run) > ORDER:
            out += pieces(run)
        run = b""
        if len(w) > ORDER:
            out += pieces(w)
    return out


def bag(text: bytes, one: dict) -> list[bytes]:
    """The different units of a text's sentences; `one` holds each unit once for all texts."""
    return sorted({one.setdefault(u, u) for s in SENTENCE.split(text) for u in units_of(s)})


class Model:
    """f(unit) = theta . features(unit) / norm + bias: the machine with all landmarks folded into one weight for each subsequence. A text's score comes from its best unit."""

    def __init__(self):
        self.theta, self.bias, self.slope, self.shift = np.zeros(FOLD**ORDER, np.float32), 0.0, 0.0, -50.0

    def values(self, units: list[bytes]) -> np.ndarray:
        out = np.full(len(units), self.bias)
        for which, m in by_length(units):
            ids, w, norm = subsequences(m)
            out[which] = self.theta[ids] @ w / norm + self.bias
        return out

    def pack(self) -> tuple:
        """As a row (place, weight, bias, slope, shift): the weights that are not 0, a few hundred kB."""
        at = np.flatnonzero(self.theta).astype("<i4")
        return at.tobytes(), self.theta[at].astype("<f4").tobytes(), self.bias, self.slope, self.shift

    @classmethod
    def unpack(cls, place: bytes, weight: bytes, bias: float, slope: float, shift: float) -> Model:
        out = cls()
        out.theta[np.frombuffer(place, "<i4")] = np.frombuffer(weight, "<f4")
        out.bias, out.slope, out.shift = bias, slope, shift
        return out

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -50, 50)))


def likelihood_ratio(a: np.ndarray, b: np.ndarray, np_: int, nn: int) -> np.ndarray:
    """Evidence that what is in a of np_ toxic texts and in b of nn clean ones is more frequent in the toxic ones."""
    a, b = np.asarray(a, float), np.asarray(b, float)

    def term(k: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(s), 0) + np.where(n > k, (n - k) * np.log(1 - s), 0)

    p, q, r = a / np_, b / nn, (a + b) / (np_ + nn)
    return np.where(p <= q, 0.0, 2 * (term(a, np_, p) + term(b, nn, q) - term(a + b, np_ + nn, r)))


class Grams:
    """Of each unit the runs of ORDER characters in it, and its beginnings of up to three more, as numbers."""

    def __init__(self, units: list[bytes]):
        n = np.array([len(u) for u in units], np.int64)
        first = np.array([u[0] == MARK for u in units], bool)
        many = np.where(n >= ORDER, n - ORDER + 1 + np.where(first, np.clip(n - ORDER, 0, 3), 0), 0)
        self.at = np.append(0, np.cumsum(many))
        self.of = np.repeat(np.arange(len(units), dtype=np.int32), many)
        self.gram = np.zeros(len(self.of), np.int64)
        power = 64 ** np.arange(ORDER + 3)
        for which, m in by_length(units):
            n, m, at = m.shape[1], m + 1, self.at[which]
            for k in range(n - ORDER + 1):
                self.gram[at + k] = m[:, k : k + ORDER] @ power[:ORDER]
            first = m[:, 0] == MARK + 1
            for k in range(ORDER + 1, min(n, ORDER + 3) + 1):
                self.gram[at[first] + n - 2 * ORDER + k] = m[first, :k] @ power[:k]

    def set_of(self, units: np.ndarray) -> np.ndarray:
        """The different ones of some units."""
        n = self.at[units + 1] - self.at[units]
        return np.unique(self.gram[np.repeat(self.at[units] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])

    def best(self, strong: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """For each of n units the greatest value of those of its grams that are among the strong ones (sorted), else 0."""
        out = np.zeros(n)
        if len(strong):
            k = np.minimum(np.searchsorted(strong, self.gram), len(strong) - 1)
            hit = np.flatnonzero(strong[k] == self.gram)
            np.maximum.at(out, self.of[hit], value[k[hit]])
        return out


def dealt(lists: list[list]) -> list:
    """The first of each list, the second of each, and so on; each thing once."""
    return [x for x in dict.fromkeys(x for row in itertools.zip_longest(*lists) for x in row) if x is not None]


def fit(of: list[list[bytes]], toxic: list[int], strata: list | None = None, seed: int = 3) -> Model:
    """Learn from the units of labelled texts (bag()), by sentences.

    A toxic text has some toxic sentence, a clean one has none. Units found in more toxic texts than chance allows make the first positive examples, with copies that
    have a character inserted; chance is reckoned over all texts and within each stratum (such as a language), and strata take turns in examples and landmarks; units of sentences of clean texts are the negative ones. Landmarks are diverse positive units and frequent negative ones. The machine is
    trained, then once more with the best unit of the best sentence of each toxic text and the worst mistakes among the clean. A logistic curve over the best units of
    whole texts, through the cut with the fewest errors, gives the probability.

    Bounds, whatever the size of the corpus: EXAMPLES positive units at first (and the best unit of each toxic text after that), FREQUENT of the most frequent clean units
    of each stratum's turn and OTHERS drawn from the rest, MISTAKES of the clean units in the second round; the landmarks, LANDMARKS of them, are picked among the first
    CANDIDATES of each kind.
    """
    model, rng = Model(), np.random.default_rng(seed)
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        model.shift = 50.0 if y.any() else -50.0
        return model
    strata = strata or [""] * len(of)
    units = sorted({u for x in of for u in x})
    index = {u: k for k, u in enumerate(units)}
    texts = [np.array([index[u] for u in x], np.int32) for x in of]
    del index
    count = lambda which: np.bincount(np.concatenate([np.zeros(0, np.int64), *(texts[k] for k in which)]), minlength=len(units))
    pos, neg, grams = count(np.flatnonzero(y)), count(np.flatnonzero(~y)), Grams(units)
    np_, nn = int(y.sum()), int((~y).sum())

    def evidence(which: list[int]) -> list[tuple[float, bytes]]:
        """Units of toxic texts among these by their own evidence, or by that of the strongest run of ORDER characters, or beginning of 4 to 6 letters, in them; greatest first."""
        on, off = [k for k in which if y[k]], [k for k in which if not y[k]]
        p, q = count(on), count(off)
        often, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(grams.set_of(texts[k]) for k in on)]), return_counts=True)
        often, n = often[n >= 3], n[n >= 3]
        clean = np.zeros(len(often) + 1, np.int64)
        for k in off:
            g = grams.set_of(texts[k])
            at = np.searchsorted(often, g)
            at = at[often[np.minimum(at, len(often) - 1)] == g] if len(often) else at[:0]
            clean[at] += 1
        r = likelihood_ratio(n, clean[:-1], len(on), len(off))
        r = np.maximum(np.where(p >= 2, likelihood_ratio(p, q, len(on), len(off)), 0), np.where(neg == 0, grams.best(often[r >= 15], r[r >= 15], len(units)), 0))
        r = np.where(p > 0, r, -1)
        return sorted(((float(r[k]), units[k]) for k in np.flatnonzero(r > 0 if (r > 0).any() else r == 0)), reverse=True)

    within = [[k for k, s in enumerate(strata) if s == one] for one in sorted(set(strata), key=str)]
    ranked = [evidence(x) for x in within if y[x].any() and not y[x].all()] + ([evidence(list(range(len(of))))] if len(within) > 1 else [])
    good = dealt([[u for r, u in x if r >= 15] for x in ranked])[:EXAMPLES] or dealt([[u for _, u in x[:10]] for x in ranked])[:10]
    if not good:
        return model
    by_frequency = lambda c: np.lexsort((np.arange(len(c)), -c))[: int((c > 0).sum())]
    frequent = dealt([by_frequency(count([k for k in x if not y[k]]))[:FREQUENT].tolist() for x in within])[:FREQUENT]
    others = np.setdiff1d(by_frequency(neg), frequent)
    others = others[np.lexsort((others, -neg[others]))]
    if len(others) > OTHERS:
        others = others[np.sort(rng.choice(len(others), OTHERS, False))]
    frequent, rest = [units[k] for k in frequent], [units[k] for k in others]
    marks: list[bytes] = []
    for source, most in ((good, LANDMARKS * 2 // 3), (frequent, LANDMARKS)):
        sims = kernel(source[:CANDIDATES], source[:CANDIDATES])
        chosen: list[int] = []
        for k in range(min(CANDIDATES, len(source))):
            if len(marks) + len(chosen) < most and (not chosen or sims[k, chosen].max() < 0.8):
                chosen.append(k)
        marks += [source[k] for k in chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    whiten = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])

    def inserted(u):
        k = int(rng.integers(1, len(u)))
        return u[:k] + bytes([int(rng.integers(0, 26))]) + u[k:]

    def learn(p: list[bytes], n: list[bytes]) -> None:
        place = {u: k for k, u in enumerate(units)}
        often = np.array([max(1, pos[place[u]]) for u in p] * 2 + [math.sqrt(max(1, neg[place[u]])) for u in n])
        del place
        p = p + [inserted(u) for u in p]
        each = p + n
        x = np.ones((len(each), whiten.shape[1] + 1), np.float32)
        for k in range(0, len(each), 2000):
            x[k : k + 2000, :-1] = kernel(each[k : k + 2000], marks) @ whiten.astype(np.float32)
        t = np.array([1.0] * len(p) + [-1.0] * len(n))
        w = svm(x, t, often * np.where(t > 0, 0.5 / often[t > 0].sum(), 0.5 / often[t < 0].sum()) * len(t))
        alpha = whiten @ w[:-1]
        theta = np.zeros(FOLD**ORDER)
        for which, m in by_length(marks):
            ids, weight, norm = subsequences(m)
            for k, row, z in zip(which, ids, norm, strict=True):
                np.add.at(theta, row, alpha[k] * weight / z)
        model.theta, model.bias = theta.astype(np.float32), float(w[-1])

    learn(good, frequent + rest)
    f = model.values(units)
    best = {x[np.lexsort((x, f[x]))[-1]] for x, t in zip(texts, y, strict=True) if t and len(x)}
    wrong = np.lexsort((np.arange(len(f)), -np.where(neg > 0, f, -np.inf)))[: min(MISTAKES, int((neg > 0).sum()))]
    learn(sorted(set(good) | {units[k] for k in best if f[k] > 0 and not neg[k]}), list(dict.fromkeys([*frequent, *(units[k] for k in wrong), *rest])))
    f = model.values(units)
    top = np.array([f[x].max() if len(x) else model.bias for x in texts])
    # the cut with the fewest errors, in the middle of the widest such gap; then the slope of the curve through it
    order = np.sort(np.unique(top))
    cuts = (order[1:] + order[:-1]) / 2 if len(order) > 1 else order
    on = np.sort(top[y])
    off = np.sort(top[~y])
    errors = np.searchsorted(on, cuts) + len(off) - np.searchsorted(off, cuts)
    gap = np.diff(order) if len(order) > 1 else np.ones(1)
    cut = float(cuts[np.lexsort((-gap, errors))[0]])
    prior = np.where(y, (np_ + 1) / (np_ + 2), 1 / (nn + 2))  # Platt's targets
    slopes = np.geomspace(0.5, 60, 60)
    loss = [-(prior * np.log(p := np.clip(1 / (1 + np.exp(-np.clip(z * (top - cut), -50, 50))), 1e-12, 1 - 1e-12)) + (1 - prior) * np.log(1 - p)).sum() for z in slopes]
    model.slope = float(slopes[int(np.argmin(loss))])
    model.shift = -model.slope * cut
    return model


class Scorer:
    """Best unit values of texts; a token's value is worked out once and remembered, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def best(self, texts: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        words = [t.lower().split() for t in texts]
        every = [w for ws in words for w in ws]
        known = self.known
        if new := [w for w in dict.fromkeys(every) if w not in known]:
            units, at = [], []
            for n, w in enumerate(new):
                c = code(w.decode(errors="ignore").lower())
                known[w] = SINGLE if len(c) == 2 else self.model.bias
                if len(c) > ORDER:
                    more = pieces(c)
                    units += more
                    at += [n] * len(more)
            value = np.full(len(new), -np.inf)
            np.maximum.at(value, at, self.model.values(units))
            for n in np.flatnonzero(np.isfinite(value)).tolist():
                known[new[n]] = float(value[n])
        f = np.fromiter(map(known.__getitem__, every), float, len(every))
        out = np.full(len(texts), self.model.bias)
        many = np.array(list(map(len, words)), np.int64)
        ends = np.cumsum(many)
        full = np.flatnonzero(many)
        if len(full):
            out[full] = np.maximum(self.model.bias, np.maximum.reduceat(f, (ends - many)[full]))
        single = f == SINGLE
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(single[3:] & single[2:-1] & single[1:-2] & single[:-3]), side="right")).tolist():
            runs = [u for u in units_of(b" ".join(w if s else b"--" for w, s in zip(words[k], single[ends[k] - many[k] : ends[k]], strict=True)))]
            if runs:
                out[k] = max(out[k], float(self.model.values(runs).max()))
        return out


SCORERS: dict[int, Scorer] = {}


def quotas(counts: dict, most: int) -> dict:
    """How many to take of each: half of `most` by count, half equally; what some don't have goes to the others."""
    if (total := sum(counts.values())) <= most:
        return counts
    low, high = 0.0, float(most)
    at = lambda level: {k: min(n, int(most / 2 * n / total + level)) for k, n in counts.items()}
    for _ in range(50):
        level = (low + high) / 2
        low, high = (level, high) if sum(at(level).values()) <= most else (low, level)
    return at(low)


def sample(docs: DataFrame, known: DataFrame, most: dict[int, int]) -> DataFrame:
    """doc_id, toxic and stratum (the language; those beyond the 200 most frequent are one) of what is learned from. Only ids and languages are read for it."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    ids = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("stratum"))
    x = known.join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("stratum").alias("stratum"))
    x = saved(x.withColumn("place", F.xxhash64("doc_id") / 2.0**64 + 0.5), "toxic-labels")
    some = [r.stratum for r in x.groupBy("stratum").count().orderBy(F.desc("count"), "stratum").limit(200).collect()]
    x = x.withColumn("stratum", F.when(F.col("stratum").isin(some), F.col("stratum")).otherwise(""))
    counts = {(r.toxic, r.stratum): r["count"] for r in x.groupBy("toxic", "stratum").count().collect()}
    take: dict = {}
    for t, n in most.items():
        take |= quotas({k: c for k, c in counts.items() if k[0] == t}, n)
    # what is surely enough of each by its hash, then the first of these
    some = x.sparkSession.createDataFrame([(*k, min(1.0, (2 * n + 50) / counts[k])) for k, n in take.items()], "toxic int, stratum string, part double")
    found = x.join(F.broadcast(some), ["toxic", "stratum"]).filter("place <= part").select("doc_id", "toxic", "stratum", "place").toPandas().sort_values(["place", "doc_id"])
    found = [g.head(take[k]) for k, g in found.groupby(["toxic", "stratum"])]
    return x.sparkSession.createDataFrame([(int(i), int(t), s) for g in found for i, t, s in zip(g["doc_id"], g["toxic"], g["stratum"], strict=True)], "doc_id long, toxic int, stratum string")


def learned(rows: DataFrame) -> tuple:
    """fit() of rows (doc_id, text, toxic, stratum), a packed model. One task learns, so that a lost one is run again and the driver holds no texts; a text's units are
    kept in place of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_use("fit", lambda: None)
        one, of, toxic, strata = {}, [], [], []
        for b in small(batches):
            of += [bag(t, one) for t in b.column(0).cast(pa.binary()).to_pylist()]
            toxic += b.column(1).to_pylist()
            strata += b.column(2).to_pylist()
        del one
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in fit(of, toxic, strata).pack()], ["place", "weight", "bias", "slope", "shift"])

    rows = rows.repartition(1).sortWithinPartitions("doc_id", "text").select("text", "toxic", "stratum")
    out = saved(rows.mapInArrow(run, "place binary, weight binary, bias double, slope double, shift double"), "toxic-model", rows=500)
    found = out.collect()
    dropped(out)
    return tuple(found[0]) if found else Model().pack()  # an empty table may have no task


def toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) and labels (doc_id, toxic, ...) to docs (or those of its columns in `keep`) with held_out, score and predicted in place of any columns of
    these names, saved in the shared folder.

    Learns from labelled documents whose crc32 of doc_id as text is not divisible by 5, at most `most_toxic` and `most_clean` of them: half dealt by
    how many a language has and half equally, in the order of a hash within each. The language is docs' lang, where there is one, and only picks what is learned from. A doc_id
    with several labels is toxic if one says so; null labels and labels of null doc_ids don't count. Scoring is one pass over whole texts without a shuffle; only the
    text is an input of a score. Null and empty texts have no units and get the score of the bias. Without labels of both classes all scores are near 0 (near 1 if all
    labels are toxic). Every row is scored by itself, also where rows repeat; a null doc_id counts as held out. Empty tables give no rows.
    """
    spark = docs.sparkSession
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0))
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(remainder != 0)
    some = sample(docs, known, {1: most_toxic, 0: most_clean})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").filter("text is not null").select("doc_id", "text", "toxic", "stratum")
    given = spark.sparkContext.broadcast(learned(rows))
    number = int(time.time_ns())  # which model a worker remembers tokens' values for

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_use("values", SCORERS.clear)
        if number not in SCORERS:
            SCORERS.clear()
            SCORERS[number] = Scorer(Model.unpack(*given.value))
        for b in small(batches):
            texts = [t or b"" for t in b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
            score = SCORERS[number].model.probability(SCORERS[number].best(texts))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    d = docs.drop("held_out", "score", "predicted").withColumn("held_out", remainder == 0)
    names = [c for c in d.columns if keep is None or c in (*keep, "held_out")]
    schema = T.StructType([*(f for f in d.schema.fields if f.name in names), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return saved(d.select("text", *(c for c in names if c != "text")).mapInArrow(run, schema), "toxic-scores", rows=500)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels"), keep=["doc_id"])
