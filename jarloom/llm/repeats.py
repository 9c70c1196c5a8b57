"""What substring dedup over words and over bytes share: runs of windows by a key that their content fixes, comparison under a key, removal of intervals.

A window is `width` consecutive elements of a document. Each window has a key that depends on its content alone, so equal windows have equal keys. Neighbouring windows of
a document with one key are a run: one row (_d, _o, key, i0, n, fp), fp being a hash of all elements that the run covers. Under a key, rows with equal n and fp are taken to cover
equal text. What is left to compare window by window are the distinct texts under a key that has several.

Copies are added up before they are shuffled: of equal runs in a stretch of documents one stands for all. And keys prefer content that a sample of documents does not show
to be frequent (hot_keys()), so that a line that is in many documents, each time between others, does not bring their windows together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, dropped, mix, most_frequent, saved, small

ROWS = "_d long, _o long, key long, i0 int, n int, fp long, p int, m int"  # p: where in the run its key stands; m: how many equal runs it stands for; key is null for a run that is known to go
SAMPLE_PART, HOT_SHARE, HOT_LEAST, HOT_MOST = 32, 0.001, 24, 100_000  # a key is hot in so large a share of a sample of documents, and so many times; so many keys at most
HELD_ROWS = 200_000  # runs that are added up at a time
BROADCAST_ROWS = 400_000  # of two numbers: about 30 MB
ODD, INVERSE = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Prefix:
    """Polynomial hashes of any range of a sequence of 64-bit numbers."""

    def __init__(self, h: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.full(len(h) + 1, ODD, U64)
            power[0] = 1
            self.back = np.full(len(h) + 1, INVERSE, U64)
            self.back[0] = 1
            power, self.back = np.cumprod(power, dtype=U64), np.cumprod(self.back, dtype=U64)
            self.sum = np.zeros(len(h) + 1, U64)
            np.cumsum(h * power[:-1], dtype=U64, out=self.sum[1:])

    def range(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sum[b] - self.sum[a]) * self.back[a])

    def windows(self, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sum[width:] - self.sum[:-width]) * self.back[:-width])


def runs(key: np.ndarray, valid: np.ndarray, doc: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows and lengths of the runs. key, doc and own (the window's hash) are given for each place, valid where a window starts.

    A run that holds a window twice is given window by window.
    """
    starts = valid.copy()
    starts[1:] &= ~(valid[:-1] & (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]))
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    run = np.cumsum(starts)[at]
    order = np.argsort(own[at], kind="stable")
    o, r = own[at][order], run[order]
    twice = (o[1:] == o[:-1]) & (r[1:] == r[:-1])
    if twice.any():
        split = np.zeros(run[-1] + 1, bool)
        split[r[1:][twice]] = True
        starts[at[split[run]]] = True
    first = np.flatnonzero(starts)
    return first, np.diff(np.searchsorted(at, first), append=len(at))


class Hot:
    """Which 64-bit keys are hot; most are told apart by their lowest bits."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.low = np.sort(keys.astype(U64)), np.zeros(1 << 16, bool)
        self.low[(self.keys & U64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The places in h of hot keys."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.low[(h & U64(0xFFFF)).astype(np.int64)])
        return at[self.keys[np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)] == h[at]]


NONE_HOT = Hot(np.zeros(0, U64))


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    for b in small(batches, rows=100_000):
        yield b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).cast(pa.binary()).to_pylist()


def hot_keys(d: DataFrame, cut: Callable) -> Hot:
    """Keys that are frequent in one of SAMPLE_PART parts of the documents. What it finds only decides what is a key, not what is equal."""
    some = d.filter(F.pmod(F.xxhash64("_d", "_o"), F.lit(SAMPLE_PART)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in texts_of(batches):
            of, key, *_ = cut(texts, NONE_HOT)
            key = np.unique(np.stack([key, of.astype(U64)]), axis=1)[0] if len(key) else key  # once a document
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "c"])

    least = max(HOT_LEAST, HOT_SHARE * some.count())
    x = saved(some.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).filter(F.col("c") >= least), "hot-keys", rows=512)
    out = Hot(most_frequent(x, HOT_MOST).toArrow().column("key").to_numpy().view(U64))
    dropped(x)
    return out


def run_rows(d: DataFrame, cut: Callable, every: bool) -> DataFrame:
    """cut(texts, hot) to (index of text, key, i0, n, fp, p). Equal runs of a stretch of documents are one row, the earliest; the others go, and this one too if `every`."""
    given = d.sparkSession.sparkContext.broadcast(hot_keys(d, cut))

    def added_up(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        d_, o, key, i0, n, fp, p_ = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((i0, o, d_, fp, n, key))
        d_, o, key, i0, n, fp, p_ = (x[order] for x in (d_, o, key, i0, n, fp, p_))
        new = np.append(True, (key[1:] != key[:-1]) | (n[1:] != n[:-1]) | (fp[1:] != fp[:-1]))[: len(key)]
        first = np.flatnonzero(new)
        m = np.diff(first, append=len(key))
        gone = ~new
        if every:
            gone[first[m > 1]] = True
        a, b = first, np.flatnonzero(gone)
        no = np.ones(len(b), bool)
        columns = [np.concatenate([x[a], x[b]]) for x in (d_, o, key.view(np.int64), i0.astype(np.int32), n.astype(np.int32), fp.view(np.int64), p_.astype(np.int32))] + [np.concatenate([m, 0 * b]).astype(np.int32)]
        none = np.concatenate([np.zeros(len(a), bool), no])
        for c in range(0, len(none), 50_000):
            p = slice(c, c + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[p], mask=none[p] if k in (2, 5) else None) for k, x in enumerate(columns)], ["_d", "_o", "key", "i0", "n", "fp", "p", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for ids, os, texts in texts_of(batches):
            of, *rest = cut(texts, given.value)
            held.append((ids[of], os[of], *rest))
            rows += len(of)
            if rows >= HELD_ROWS:
                yield from added_up(held)
                held, rows = [], 0
        if rows:
            yield from added_up(held)

    return d.mapInArrow(run, ROWS)


def compared(rows: DataFrame, name: str, keep: Callable = saved) -> DataFrame:
    """Rows under keys of several rows, with same (another row covers equal text), first (the earliest of those) and mixed (the key has several texts); and the rows without a key."""
    rows = rows.withColumns({"deal": F.coalesce("key", F.xxhash64("_d", "_o", "i0")), "gone": F.col("key").isNull()})  # columns, or each window would shuffle anew
    key = W.partitionBy("deal", "gone")
    order = key.orderBy("n", "fp", "_d", "_o", "i0")
    equal = lambda f: F.coalesce((f("n").over(order) == F.col("n")) & (f("fp").over(order) == F.col("fp")), F.lit(False))
    x = rows.withColumns({"before": equal(F.lag), "after": equal(F.lead)})
    x = x.withColumns({"rows": F.count("*").over(key), "mixed": (F.min("fp").over(key) != F.max("fp").over(key)) | (F.min("n").over(key) != F.max("n").over(key))})
    x = x.filter("rows > 1 or key is null").select("_d", "_o", "key", "i0", "n", "p", F.coalesce("mixed", F.lit(False)).alias("mixed"), "rows", (F.col("before") | F.col("after")).alias("same"), (~F.col("before")).alias("first"))
    return keep(x, name, rows=512)


def only(d: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these (_d, _o); the ids are broadcast if they are few by count."""
    ids = ids.select("_d", "_o").distinct()
    return d.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, ["_d", "_o"], "left_semi")


def fetched(d: DataFrame, asked: DataFrame, columns: list[str]) -> DataFrame:
    """The texts of the documents that `asked` has rows of, with those rows as the array `asked`."""
    by = asked.groupBy("_d", "_o").agg(F.collect_list(F.struct(*columns)).alias("asked"))
    return only(d, by).join(by, ["_d", "_o"])


def asked_of(asked: pa.Scalar, at: int, most: int) -> dict[str, np.ndarray]:
    """Some of the rows of an array of structs, by column; without an object for each."""
    rows = asked.values.slice(at, most)
    return {rows.type.field(k).name: rows.field(k).to_numpy(zero_copy_only=False) for k in range(rows.type.num_fields)}


def without(d: DataFrame, gone: DataFrame, cut: Callable, schema: str, keep: Callable = saved) -> DataFrame:
    """cut(text, starts, ends) to a row, for each document with the intervals (a, b) of `gone` that are its own."""
    by = gone.groupBy("_d", "_o").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            whole = lambda x: np.zeros(0, np.int64) if x.values is None else x.values.to_numpy().astype(np.int64)
            rows = [cut(t, whole(x), whole(y)) for t, x, y in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3), b.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x) for x in zip(*rows, strict=True))], ["_d", "_o", *names])

    x = d.join(by, ["_d", "_o"], "left").select("_d", "_o", "text", "a", "b")
    out = keep(x.mapInArrow(run, f"_d long, _o long, {schema}"), "cut-out", rows=512)
    dropped(gone)
    return out
