"""Approximate nearest neighbours: low-dimensional stable projections in a kd-tree, with a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, read, saved

DIMS = 8  # of the projection; even, so that the chi-square distribution has a closed form
CONFIDENCE = 0.95  # that a true neighbour within the present distance has not been left out by the stopping test
SAMPLE = 20_000  # vectors, about, that the kd-tree's planes are fitted on
CELL = 4096  # distinct vectors that a cell holds at most, as the sample tells
BUCKET = 256  # points that a leaf of the tree inside a cell holds
MOST_CELLS = 65_536
QUERY_BLOCK = 16_384


def chi2_cdf(x: np.ndarray, m: int) -> np.ndarray:
    term, total = np.ones_like(x), np.ones_like(x)
    for k in range(1, m // 2):
        term = term * (x / 2) / k
        total = total + term
    return 1 - np.exp(-x / 2) * total


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(np.array(mid), m) < p else (lo, mid)
    return hi


class Tree:
    """The upper part of the kd-tree: planes at medians of the sample, a node's children at 2k + 1 and 2k + 2; leaves are cells with the boxes that planes leave."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, m = depth, sample.shape[1]
        self.dim, self.at = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        self.low, self.high = np.full((2**depth, m), -np.inf), np.full((2**depth, m), np.inf)
        parts, boxes = [sample], [(np.full(m, -np.inf), np.full(m, np.inf))]
        for level in range(depth):
            below, inner = [], []
            for k, (x, (lo, hi)) in enumerate(zip(parts, boxes, strict=True)):
                d = int(np.argmax(np.ptp(x, axis=0))) if len(x) else 0
                at = float(np.median(x[:, d])) if len(x) else 0.0
                self.dim[2**level - 1 + k], self.at[2**level - 1 + k] = d, at
                left, right = x[:, d] < at, x[:, d] >= at
                below += [x[left], x[right]]
                h2, l2 = hi.copy(), lo.copy()
                h2[d], l2[d] = min(hi[d], at), max(lo[d], at)
                inner += [(lo, h2), (l2, hi)]
            parts, boxes = below, inner
        for k, (lo, hi) in enumerate(boxes):
            self.low[k], self.high[k] = lo, hi

    def cell(self, x: np.ndarray) -> np.ndarray:
        k = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            k = 2 * k + 1 + (x[np.arange(len(x)), self.dim[k]] >= self.at[k])
        return k - (2**self.depth - 1)

    def squared(self, q: np.ndarray) -> np.ndarray:
        """Squared distances from a point to all boxes."""
        return (np.maximum(0, np.maximum(self.low - q, q - self.high)) ** 2).sum(1)


class Geometry:
    """Vectors as points whose Euclidean order from a query is that of inner products: (x, sqrt(M^2 - |x|^2)), and M q / |q| with a 0; then projected by Gaussians."""

    def __init__(self, dim: int, norm: float, seed: int = 7):
        self.dim, self.norm = dim, norm
        self.axes = np.random.default_rng(seed).standard_normal((dim + 1, DIMS))

    def points(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([v, np.sqrt(np.maximum(0, self.norm**2 - (v**2).sum(1)))[:, None]], 1) @ self.axes

    def queries(self, v: np.ndarray) -> np.ndarray:
        return (v * (self.norm / np.linalg.norm(v, axis=1))[:, None]) @ self.axes[:-1]

    def distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Squared distance of the point with this inner product."""
        return np.maximum(0, 2 * self.norm**2 - 2 * score * (self.norm / np.linalg.norm(q, axis=1)))


def stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 1))


def search(cell: pd.DataFrame, asked: pd.DataFrame, g: Geometry, k: int, bound: float) -> Iterator[tuple]:
    """Best vectors of a cell for each query: (qid, vec ids, scores), at most k + 1 ids. A query's `kth` is the score that it has k others of already, or -inf.

    Inside the cell a kd-tree of buckets is visited by each query from near to far in the projection. A bucket's points are verified, the k-th best distance d is
    updated, and a query stops at the first bucket whose squared projected distance exceeds the chi-square bound times d^2.
    """
    vec, ids = stack(cell["v"]), cell["ids"].to_numpy()
    depth = max(0, math.ceil(math.log2(max(1, len(vec)) / BUCKET)))
    pts = g.points(vec)
    tree = Tree(pts, depth)
    of = tree.cell(pts)
    buckets = [np.flatnonzero(of == b) for b in range(2**depth)]
    for a in range(0, len(asked), 512):
        part = asked.iloc[a : a + 512]
        q, kth = stack(part["v"]), part["kth"].to_numpy(dtype=float).copy()
        proj = g.queries(q)
        far = np.stack([tree.squared(p) for p in proj])
        order = np.argsort(far, axis=1)
        live = np.arange(len(q))
        best_s = np.full((len(q), k + 1), -np.inf)
        best_i = np.full((len(q), k + 1), -1)
        for step in range(2**depth):
            near = far[live, order[live, step]]
            keep = near <= bound * g.distance(q[live], kth[live]) if np.isfinite(kth).any() else np.ones(len(live), bool)
            keep |= ~np.isfinite(kth[live])
            live = live[keep]
            if not len(live):
                break
            for b in np.unique(order[live, step]):
                who = live[order[live, step] == b]
                if not len(rows := buckets[b]):
                    continue
                s = np.concatenate([best_s[who], q[who] @ vec[rows].T], 1)
                i = np.concatenate([best_i[who], np.broadcast_to(rows, (len(who), len(rows)))], 1)
                top = np.argsort(-s, axis=1, kind="stable")[:, : k + 1] if s.shape[1] <= 64 else near_top(s, k + 1)
                best_s[who], best_i[who] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
                kth[who] = np.maximum(kth[who], best_s[who, -1])
        for n, qid in enumerate(part["qid"].to_numpy()):
            got = best_i[n] >= 0
            yield qid, [int(x) for r in best_i[n][got] for x in ids[r]], [float(s) for s, r in zip(best_s[n][got], best_i[n][got], strict=True) for _ in ids[r]]


def near_top(s: np.ndarray, n: int) -> np.ndarray:
    top = np.argpartition(-s, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, confidence: float = CONFIDENCE) -> DataFrame:
    """vectors (vec_id, embedding, ...) to query_id, rank, vec_id, score: the k largest inner products found for each vec_id divisible by `every`.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do those of another length than the most frequent one (the smaller of two), nor
    null vec_ids. Ties go to the smaller vec_id. Rows that repeat a vec_id are candidates of their own for others; a query is asked once for each vec_id and vector.

    Equal vectors are one point with its k + 1 smallest ids (no other can be in an answer) and are asked once, so a group of copies of any size is one row. Points lie in
    the cells of a kd-tree over a projection to DIMS dimensions, its planes fitted on about SAMPLE vectors (all, if fewer); all vectors are in cells, and every cell is a task's group
    of about CELL points (more, if there are over MOST_CELLS times CELL). Cells are searched in rounds, from near to far in the projection: first each query's own, then
    the next 4, 16 and so on; after each round the k-th score so far bounds, by the stopping test, where a query still goes, and no further round comes when none does.
    Queries of a cell come in blocks of QUERY_BLOCK, with the cell's points for each block that asks it. Scores are double inner products of the original vectors.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0")
    v = v.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).filter(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    schema = "query_id long, rank int, vec_id long, score double"
    common = v.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], schema)
    ids = F.col("vec_id")
    p = v.filter(F.col("dim") == common["dim"]).select("vec_id", "v", F.xxhash64("v").alias("h"))
    # the k + 1 smallest ids of a vector, taken from salted parts of its rows first
    at = F.row_number().over(W.partitionBy("h", "v", "salt").orderBy("vec_id"))
    cut = p.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("at", at)
    few = cut.filter(F.col("at") <= k + 1).groupBy("h", "v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    points = saved(few.withColumn("pid", F.monotonically_increasing_id()), "ann-points")
    wants = saved(p.filter(ids % every == 0).select("vec_id", "h", "v").distinct().join(points.select("h", "v", "pid"), ["h", "v"]).select("vec_id", "pid"), "ann-wants")
    n, norm = points.agg(F.count("*"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    g = Geometry(common["dim"], norm)
    # the sample is drawn by a hash, so nothing is sorted, and projected where it is: DIMS numbers of a vector come to the driver
    drawn = points if n <= SAMPLE else points.filter(F.pmod(F.xxhash64("h"), F.lit(2**32)) < F.lit(int(SAMPLE / n * 2**32)))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame(g.points(stack(f["v"])), columns=[f"x{k}" for k in range(DIMS)]) if len(f) else pd.DataFrame(columns=[f"x{k}" for k in range(DIMS)])

    sample = drawn.select("v").mapInPandas(project, ", ".join(f"x{k} double" for k in range(DIMS))).toPandas().to_numpy(dtype=float)
    tree = Tree(sample, min(int(math.log2(MOST_CELLS)), max(0, math.ceil(math.log2(n / CELL)))))
    given = spark.sparkContext.broadcast((g, tree))
    bound = chi2_quantile(confidence, DIMS)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, tree = given.value
        for f in frames:
            yield f.assign(cell=tree.cell(g.points(stack(f["v"]))).astype("int32"))

    points = saved(points.select("pid", "v", "ids").mapInPandas(place, "pid long, v array<double>, ids array<long>, cell int"), "ann-cells")
    queries = saved(wants.select("pid").distinct().join(points.select("pid", "v"), "pid").select(F.col("pid").alias("qid"), "v"), "ann-queries")
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    found_schema, sent = "qid long, ids array<long>, scores array<double>", "qid long, kth double, cell int, block int"

    def inside(key, cell: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = list(search(cell, asked, given.value[0], k, bound)) if len(cell) and len(asked) else []
        return pd.DataFrame(rows, columns=["qid", "ids", "scores"])

    def cells(lo: int, hi: int):
        """Of each query's cells from near to far those from the lo-th up to the hi-th, its own being the first, that the stopping test with the k-th score so far does not rule out."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, tree = given.value
            for f in frames:
                if not len(f):
                    continue
                q, kth = stack(f["v"]), f["kth"].to_numpy(dtype=float)
                proj, d = g.queries(q), g.distance(q, np.where(np.isfinite(kth), kth, 0))
                home = tree.cell(proj)
                for n, (qid, block) in enumerate(zip(f["qid"], f["block"], strict=True)):
                    far = tree.squared(proj[n])
                    far[home[n]] = -1
                    go = np.argsort(far, kind="stable")[lo:hi]
                    go = go[far[go] <= (bound * d[n] if np.isfinite(kth[n]) else np.inf)]
                    if len(go):
                        yield pd.DataFrame({"qid": qid, "kth": kth[n], "cell": go.astype("int32"), "block": block})

        return run

    def best_of(found: DataFrame) -> DataFrame:
        ranked = found.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("scores"), "ids"))).filter(F.col("r") <= k + 1)
        return saved(ranked, "ann-best")

    best, lo, step = None, 0, 1
    while lo < 2**tree.depth:
        kth = queries.withColumn("kth", F.lit(float("-inf")))
        if best is not None:  # the score that a query has k others of, besides its own vector's
            kth = queries.join(best.filter(F.col("r") == k + 1).select("qid", F.col("scores").alias("kth")), "qid", "left").fillna(float("-inf"), ["kth"])
        asked = saved(kth.select("qid", "v", "kth", "block").mapInPandas(cells(lo, lo + step), sent), "ann-asked")
        if asked.isEmpty():  # what is further is ruled out as well
            dropped(asked)
            break
        # a cell goes only to the blocks of queries that ask it
        spread = points.join(asked.select("cell", "block").distinct(), "cell").select("cell", "block", "v", "ids")
        q = asked.join(queries.select("qid", "v"), "qid").select("qid", "kth", F.col("cell").alias("of"), F.col("block").alias("part"), "v")
        found = spread.groupBy("cell", "block").cogroup(q.groupBy("of", "part")).applyInPandas(inside, found_schema)
        found = found.select("qid", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("qid", "x.*")
        before, best = best, best_of(found if best is None else found.unionByName(best.drop("r")))
        dropped(asked, *([] if before is None else [before]))
        lo, step = lo + step, step * 4
    mine = wants.join(best, wants.pid == best.qid).filter(F.col("ids") != F.col("vec_id"))
    rank = F.row_number().over(W.partitionBy("vec_id", "pid").orderBy(F.desc("scores"), "ids"))
    return mine.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("vec_id").alias("query_id"), "rank", F.col("ids").alias("vec_id"), F.col("scores").alias("score"))


def op1_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "embeddings"))
