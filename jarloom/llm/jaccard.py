"""n-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, components, dropped, held, mix, read, real, saved, small, with_keys, word_hashes

GRAM, PERCENT = 3, 90
PARTS = 4  # fragments that a pair's overlap is counted in
BUCKETS = 256  # of a set's sketch: how many of its shingles fall into each, modulo 256
BLOCK = 1024  # members of a centre that are compared at once
BROADCAST_ROWS = 400_000  # of three numbers: about 40 MB
TASK_ROWS = 100_000  # of the first pass, for each task that writes a table made of them; LEAST_TASKS at least
LEAST_TASKS = 12
BOUNDS = [1]
while BOUNDS[-1] < 2**40:
    BOUNDS.append(max(BOUNDS[-1] + 1, BOUNDS[-1] * 3 // 2))
BOUNDS = np.array(BOUNDS)


def shingle_sets(texts: list[bytes], gram: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles."""
    words = [t.lower().split() for t in texts]
    many = [len(w) for w in words]
    h = word_hashes([w for ws in words for w in ws])
    with np.errstate(over="ignore"):
        odd = [U64(x) for x in range(0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15 + 2 * gram, 2)]
        full = h[: max(0, len(h) - gram + 1)] * odd[0]
        for k in range(1, gram):
            full = mix(full) + h[k : len(h) - gram + 1 + k] * odd[k]
        full = mix(full)
    out, at = [], 0
    for ws, n in zip(words, many, strict=True):
        if n >= gram:
            out.append(np.unique(full[at : at + n - gram + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(ws), seed=n)] if n else [], U64))
        at += n
    return out


def differing(n: int, percent: int) -> int:
    """How many elements two sets of at most n elements may differ in."""
    return 2 * n * (100 - percent) // (100 + percent)


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys that any two linked sets share at least one of.

    At a level of sizes two linked sets differ in at most D elements. The order of shingles (their hashes) is cut into D + 1 fragments, so that in one fragment they
    are equal. A set has keys at its own level and at that of the largest set it can be linked with.
    """
    n, out = len(s), []
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(s), dtype=U64)])
        first, last = np.searchsorted(BOUNDS, [n, n * 100 // percent], side="right") - 1
        for level in range(first, last + 1):
            parts = differing(int(BOUNDS[level + 1]) - 1, percent) + 1
            of = ((s >> U64(32)) * U64(parts)) >> U64(32)
            cut = np.searchsorted(of, np.arange(parts + 1, dtype=U64))
            out.append(mix((sums[cut[1:]] - sums[cut[:-1]]) ^ mix(np.arange(parts, dtype=U64) + (U64(level + 1) << U64(40)))))
    return np.concatenate(out)


def first_pass(d: DataFrame, gram: int, percent: int) -> DataFrame:
    """Of each document a row (key null; cid and c2, the 128 bits of its set) and rows (key, cid) of its signatures."""
    names = ["key", "cid", "c2", "_d", "_o", "n"]
    kinds = [pa.int64()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = b.column(2).cast(pa.binary()).to_pylist()
            for a in range(0, len(texts), 128):
                sets = shingle_sets(texts[a : a + 128], gram)
                ids = np.array([int.from_bytes(xxhash.xxh128_digest(s.tobytes()), "little") >> k & (2**64 - 1) for s in sets for k in (0, 64)], U64).view(np.int64).reshape(-1, 2)
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(sets), pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), b.column(0).slice(a, 128), b.column(1).slice(a, 128), pa.array(n)], names)
                keys = [signatures(s, percent) if len(s) else np.zeros(0, U64) for s in sets]
                own = np.repeat(ids[:, 0], [len(k) for k in keys])
                keys = np.concatenate(keys).view(np.int64)
                for c in range(0, len(keys), 20_000):
                    m = len(keys[c : c + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[c : c + m]), pa.array(own[c : c + m]), *(pa.nulls(m, k) for k in kinds[2:])], names)

    return d.mapInArrow(run, "key long, cid long, c2 long, _d long, _o long, n long")


def segments(d: DataFrame, reps: DataFrame, gram: int) -> DataFrame:
    """(rid, n, part, seg): the shingle sets of representatives, cut into PARTS fragments of the global order; part -1 is the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            for a in range(0, len(texts), 128):
                rows = []
                for rid, s in zip(rids[a : a + 128], shingle_sets(texts[a : a + 128], gram), strict=True):
                    cut = np.searchsorted(s >> U64(62), np.arange(PARTS + 1, dtype=U64))
                    rows.append((rid, len(s), -1, np.bincount((s & U64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.uint8).tobytes()))
                    rows += [(rid, len(s), k, s[cut[k] : cut[k + 1]].tobytes()) for k in range(PARTS) if cut[k] < cut[k + 1]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["rid", "n", "part", "seg"])

    few = reps.count() <= BROADCAST_ROWS
    return d.join(F.broadcast(reps) if few else reps, ["_d", "_o"]).select("rid", "text").mapInArrow(run, "rid long, n long, part int, seg binary")


def together(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, sa, sb): the fragments of both sets of each pair (a, b) whose sizes allow a link, a row for each fragment that either has."""
    x = pairs.join(segs.select(F.col("rid").alias("b"), F.col("n").alias("nb"), "part", F.col("seg").alias("sb")), "b")
    x = x.join(segs.select(F.col("rid").alias("a"), F.col("n").alias("na"), "part", F.col("seg").alias("sa")), ["a", "part"])
    return x.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "na", "nb", "sa", "sb")


def overlaps(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, same): overlaps, counted fragment by fragment and summed for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(np.intersect1d(np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64), assume_unique=True)) for x, y in zip(b.column(4), b.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(n, pa.int64())], ["a", "b", "na", "nb", "same"])

    x = together(pairs, segs, percent)
    return x.mapInArrow(run, "a long, b long, na long, nb long, same long").groupBy("a", "b", "na", "nb").agg(F.sum("same").alias("same"))


def linked(sums: DataFrame, percent: int) -> DataFrame:
    return sums.filter(100 * F.col("same") >= percent * (F.col("na") + F.col("nb") - F.col("same"))).select("a", "b")


def far_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound on how many elements sets differ in, from their sketches: each such element changes one bucket by one."""
    d = x - y  # modulo 256
    return np.minimum(d, -d).sum(-1, dtype=np.int64)


def near_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that sizes and sketches leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS) for k in (4, 5))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(far_apart(x, y) <= n * (100 - percent) // (100 + percent))) for c in b.columns[:2]], ["a", "b"])

    x = pairs.join(sketches.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("seg").alias("sa")), "a").join(sketches.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("seg").alias("sb")), "b")
    x = x.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "na", "nb", "sa", "sb")
    return x.mapInArrow(run, "a long, b long")


def members_near(members: DataFrame, percent: int, tasks: int) -> DataFrame:
    """members (centre, rid, n, comp, home, seg), home being the centre's component: pairs (a, b) of members of a centre that are in different components and that sizes
    and sketches leave. Members outside the centre's component are compared with all others, in blocks of BLOCK by BLOCK; only pairs that pass are rows.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            xs, ys = (np.frombuffer(b"".join(f["seg"]), np.uint8).reshape(-1, BUCKETS) for f in (left, right))
            rid, n, comp = (right[c].to_numpy() for c in ("rid", "n", "comp"))
            for r, m, c, s in zip(left["rid"], left["n"], left["comp"], xs, strict=True):
                ok = np.flatnonzero((comp != c) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
                ok = ok[far_apart(ys[ok], s) <= (n[ok] + m) * (100 - percent) // (100 + percent)]
                out += [(min(r, q), max(r, q)) for q in rid[ok].tolist()]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    out = F.col("comp") != F.col("home")
    numbered = members.withColumn("block", F.floor((F.row_number().over(W.partitionBy("centre").orderBy((~out).cast("int"), "rid")) - 1) / BLOCK).cast("int"))
    numbered = saved(numbered.withColumn("outside", out), "jac-members", tasks=tasks)
    many = numbered.groupBy("centre").agg(F.max(F.when(F.col("outside"), F.col("block"))).alias("lefts"), F.max("block").alias("rights"))
    x = numbered.join(many, "centre")
    left = x.filter("outside").withColumn("other", F.explode(F.expr("sequence(0, rights)"))).select("centre", F.col("block").alias("i"), F.col("other").alias("j"), "rid", "n", "comp", "seg")
    right = x.withColumn("other", F.explode(F.expr("sequence(0, lefts)"))).select("centre", F.col("other").alias("i"), F.col("block").alias("j"), "rid", "n", "comp", "seg")
    left, right = left.toDF("c", "i", "j", "rid", "n", "comp", "seg"), right.toDF("c2", "i2", "j2", "rid", "n", "comp", "seg")
    out = saved(left.groupBy("c", "i", "j").cogroup(right.groupBy("c2", "i2", "j2")).applyInPandas(run, "a long, b long").distinct(), "jac-pairs", tasks=tasks)
    dropped(numbered)
    return out


def jaccard_components(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of `gram`-word shingles (lower-case A-Z; a text of fewer words is one shingle, one
    without words has an empty set and no links; null is empty). Documents with equal sets are one class. The global order of shingles is that of their 64-bit hashes.

    1. Fragments of that order give each class keys, at least one of them shared by any two linked classes (signatures()).
    2. Under each key the other classes are compared with the first one, the key's centre. A pair's overlap is counted in PARTS fragments separately and summed.
    3. Two linked classes that are not yet in one component share a key, so both are members of its centre. Of a centre's members, those outside its component are held
       against the others by sketches that bound how much sets differ (members_near()); only pairs that can be linked are formed, and their overlaps are counted.
    Pairs inside a component need no test, so a group of copies costs in proportion to its size, and copies that have drifted apart are not all compared. Links go to
    the shared folder, and components() follows them by labels in Spark. The two tables that grow with the texts are held by executors (held()); the others are written
    by as many tasks as their rows ask, not as the session has partitions.

    Rows that share a doc_id are documents of their own with that id. A null doc_id is returned as null and is no component's smallest, unless the component has no
    other (component_id is null then). Empty tables give no rows.
    """
    d = with_keys(docs)
    rid = F.when(F.col("_o") == 0, F.col("_d")).otherwise(F.xxhash64("_d", "_o"))
    x = first_pass(d, gram, percent)
    # one shuffle by key; documents' own rows go along, dealt by their ids
    deal = F.coalesce("key", F.xxhash64("_d", "_o"))
    key = W.partitionBy(deal, F.col("key").isNull())
    x = x.withColumns({"lo": F.min("cid").over(key), "hi": F.max("cid").over(key)}).filter("key is null or lo <> hi").drop("lo", "hi")
    x = held(x, "jac-first", rows=512)
    tasks = max(LEAST_TASKS, x.count() // TASK_ROWS)
    save = partial(saved, tasks=tasks)
    sets = x.filter("key is null").drop("key")
    classes = save(sets.groupBy("cid", "c2").agg(F.min(F.struct("_d", "_o")).alias("r"), F.first("n").alias("n")).select("cid", "c2", "r.*", "n").withColumn("rid", rid), "jac-classes")
    groups = save(x.filter("key is not null").select("key", "cid").distinct().join(classes.select("cid", "rid"), "cid").select("key", "rid"), "jac-groups")
    need = groups.select("rid").distinct().join(classes.select("rid", "_d", "_o"), "rid")
    every = segs = held(segments(d, need, gram), "jac-segments", rows=512)
    least = W.partitionBy("key").orderBy("rid")
    star = groups.withColumn("a", F.first("rid").over(least)).filter("a <> rid").select("a", F.col("rid").alias("b")).distinct()
    star = save(star, "jac-star")
    sketches, segs = segs.filter("part = -1"), segs.filter("part >= 0")
    near = save(near_pairs(star, sketches, percent), "jac-near")
    found = [save(linked(overlaps(near, segs, percent), percent), "jac-links")]

    def placed(x: DataFrame, of: str, name: str) -> DataFrame:
        return x.join(comps.select(F.col("id").alias(of), F.col("comp").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))

    comps = components(found[0], "jac-comp", tasks)
    apart = placed(placed(star, "a", "home"), "b", "comp").select(F.col("a").alias("centre"), F.col("b").alias("rid"), "home", "comp")
    open_ = apart.groupBy("centre").agg(F.max(F.col("comp") != F.col("home")).alias("apart"), F.count("*").alias("m")).filter("apart and m > 1").select("centre")
    members = apart.join(open_, "centre", "left_semi").join(sketches.select("rid", "n", "seg"), "rid")
    pairs = members_near(members, percent, tasks)
    dropped(comps)
    if not pairs.isEmpty():
        found.append(save(linked(overlaps(pairs, segs, percent), percent), "jac-links"))
    comps = components(reduce(DataFrame.union, found), "jac-comp", tasks)
    dropped(groups, star, near, every, pairs, *found)
    # the smallest doc_id of a component, over all documents of its classes
    own = sets.join(classes.select("cid", "c2", "rid"), ["cid", "c2"]).join(comps.select(F.col("id").alias("rid"), "comp"), "rid", "left")
    alone = F.col("n") == 0
    own = own.select(real().alias("doc_id"), F.col("n").alias("n_shingles"), F.when(~alone, F.coalesce("comp", "rid")).alias("c"))
    least = own.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"))  # of a component
    return own.join(least, "c", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
