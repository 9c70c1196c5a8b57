"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, saved

SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 1000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """sizes (source, source_size): adds weight and target.

    Sources by code point, null last, take the weights in turn. A target is at most `most` times its source; the excess goes to the rest by weight. With the caps
    in order of cap / weight, the capped sources are a prefix, so one pass over running sums gives what repeated resharing converges to.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    upto = ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    s = s.withColumns({"total": F.sum("source_size").over(whole), "caps": F.coalesce(F.sum("cap").over(upto), F.lit(0)), "rest": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))})
    # capped where even with all before it capped its share is above its cap
    s = s.withColumn("open", F.col("weight") * (F.col("total") - F.col("caps")) <= F.col("cap") * F.col("rest"))
    first = F.struct("caps", "rest")
    s = s.withColumn("level", F.min(F.when(F.col("open"), first)).over(whole))
    free = F.col("weight") * (F.col("total") - F.col("level.caps")) / F.col("level.rest")
    capped = F.col("level").isNull() | (F.col("caps") < F.col("level.caps")) | (F.col("rest") > F.col("level.rest"))
    return s.select("source", "source_size", "weight", F.when(capped, F.col("cap").cast("double")).otherwise(free.cast("double")).alias("target"))


def mix_key(doc_id: Column, seed: str = "mix") -> Column:
    """The 52-bit place of a document in its source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """docs (doc_id, text, source, ...) to doc_id, source, size, source_size, target, taken.

    size counts the words of a text (null: 0). Each document gets a hash-random key from its id; within its source documents stand in order of the key. Every document
    is taken once for each whole epoch in its source's target, and then those before the place where the running sum of sizes meets what is left; the document at that
    place is taken in part, so that a source gives its target, rounded to a word, exactly.

    Keys are uniform, so equal ranges of keys hold about equally many rows: sums over ranges place a whole range before or after the cut, and only the range at the cut
    is put in order row by row. A source of any share of the rows is spread over its ranges. Rows that share a doc_id stand in order of size; equal rows share one
    place, and each of them is taken as that order has it. An empty table gives an empty table. Columns beyond doc_id, text and source are not read.
    """
    d = docs.select("doc_id", "source", F.coalesce(F.size(F.array_remove(F.split("text", SPACE), "")), F.lit(0)).cast("long").alias("size"), mix_key(F.col("doc_id"), seed).alias("key"))
    d = saved(d, "mix-sizes")  # a few bytes a document, so that texts are read once
    per = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    t = targets(per.select("source", "source_size"), weights, most).join(per.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    aim = F.round("target").cast("long")
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(aim / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("left", aim - F.col("epochs") * F.col("source_size")).withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS).cast("long"))
    t = saved(t.drop("n"), "mix-targets")  # a row for each source
    x = d.join(t.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    x = x.withColumn("bucket", F.floor(F.col("key") / F.lit(float(2**52)) * F.col("buckets")).cast("long"))
    sums = x.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "before", "bucket_size")
    x = x.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))).drop("s2", "b2")
    x = x.withColumn("at", F.when(F.col("before") + F.col("bucket_size") <= F.col("left"), F.lit("in")).when(F.col("before") >= F.col("left"), F.lit("out")).otherwise(F.lit("cut")))
    run = F.sum("size").over(W.partitionBy("source").orderBy("key", F.col("doc_id").isNull(), "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    cut = x.filter("at = 'cut'").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before") - run)))
    rest = x.filter("at <> 'cut'").withColumn("part", F.when(F.col("at") == "in", F.col("size")).otherwise(F.lit(0)))
    return cut.union(rest).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(sum(size)) OVER () AS BIGINT) AS total,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w FROM d GROUP BY source),
p AS (SELECT *, CAST(coalesce(sum(3 * source_size) OVER q, 0) AS BIGINT) AS caps, CAST(sum(w) OVER () - coalesce(sum(w) OVER q, 0) AS BIGINT) AS rest
    FROM s WINDOW q AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, min(CASE WHEN w * (total - caps) <= 3 * source_size * rest THEN -rest END) OVER () AS lo FROM p),
l AS (SELECT o.*, f.caps AS fcaps, f.rest AS frest FROM o LEFT JOIN (SELECT caps, rest FROM p WHERE rest = (SELECT max(rest) FROM p WHERE w * (total - caps) <= 3 * source_size * rest)) f ON true),
t AS (SELECT source, source_size, CASE WHEN frest IS NULL OR rest > frest THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * (total - fcaps) AS DOUBLE) / frest END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
x AS (SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.epochs, CAST(round(e.target) AS BIGINT) - e.epochs * e.source_size AS remaining,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS before
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, CAST(epochs * size + greatest(0, least(size, remaining - before)) AS BIGINT) AS taken FROM x
"""
