"""Benchmark decontamination by a prefix-filtered join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import back, read, saved, with_keys

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what is between words, of the text before A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 64_000_000


def lowered(w: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")  # many times faster than finding the words by a pattern


def bounded(df: DataFrame) -> DataFrame:
    """A saved table to broadcast, if it has few rows and takes few bytes, both by count; else as it is, to be shuffled."""
    size = F.lit(0)
    for name, kind in df.dtypes:
        c = F.col(name)
        size = size + (F.octet_length(c) if kind == "string" else F.octet_length(F.array_join(c, "")) + 16 * F.size(c) if kind.startswith("array") else F.lit(8))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def prefixes(items: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The necessary token of each window of the items: word, item, off, ctx, span.

    A window's tokens are ordered by how often they occur in the documents; an occurrence of the window holds its rarest word (the prefix of one token that exact
    containment needs). Neighbouring windows of an item with the same rarest word occurrence are one row: ctx holds the words that they cover, off the place of the
    rarest word in it, span the windows' length. A window with a word that no document has can't occur and has no row.
    """
    it = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.transform(words_of(F.coalesce("text", F.lit(""))), lowered).alias("ws")).filter("size(ws) > 0").distinct()
    it = saved(it.withColumn("k", F.monotonically_increasing_id()), "decon-items")
    at = it.select("k", F.posexplode("ws").alias("q", "w"))
    vocab = saved(at.select("w").distinct(), "decon-vocab")
    small = bounded(vocab)
    every = docs.select(F.explode(words_of(F.col("text"))).alias("w")).select(lowered(F.col("w")).alias("w"))
    freq = every.join(small, "w", "left_semi").groupBy("w").count() if small is not vocab else every.groupBy("w").count().join(vocab, "w", "left_semi")
    known = saved(at.join(saved(freq, "decon-freq"), "w").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("q", "count"))).alias("fs")), "decon-known")
    x = it.join(known, "k").withColumn("span", F.least(F.size("ws"), F.lit(window)))
    x = x.select("k", "item", "ws", "span", F.map_from_entries("fs").alias("fs"), F.explode(F.expr("sequence(0, size(ws) - span)")).alias("j"))
    inside = F.expr("transform(sequence(j, j + span - 1), q -> named_struct('c', coalesce(fs[q], 0L), 'q', q))")
    x = x.select("k", "item", "ws", "span", "j", F.array_min(inside).alias("least")).filter("least.c > 0")
    x = x.groupBy("k", F.col("least.q").alias("q")).agg(F.min("j").alias("j0"), F.max("j").alias("j1"), F.first("item").alias("item"), F.first("ws").alias("ws"), F.first("span").alias("span"))
    return x.select(F.expr("ws[q]").alias("w"), "item", F.expr("q - j0").alias("off"), F.expr("slice(ws, j0 + 1, j1 - j0 + span)").alias("ctx"), "span")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """docs (doc_id, text, ...) and items (item_id, text, ...) to doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item, or all words of a shorter one. A word of a document inside any occurrence of a window is hit; a document is
    contaminated if some word is hit and share * n_hit >= n_words. The rarest word of each window is joined with the words of the documents; where they meet, the
    window's place in the document follows, must lie inside the document, and its words are compared one by one.

    Null texts have no words. Empty tables give no rows, or no hits. Equal items are one; a null item_id is the empty string. Rows that share a doc_id are documents of
    their own. The items' words are broadcast only if they are few by count, else shuffled; Spark splits a skewed word's rows. Other columns are not read.
    """
    d = with_keys(docs)
    p = saved(prefixes(items, d, window), "decon-prefixes")
    found = d.select("_d", "_o", F.posexplode(words_of(F.col("text"))).alias("p", "w")).withColumn("w", lowered(F.col("w"))).join(bounded(p), "w")
    found = found.withColumn("at", F.col("p") - F.col("off")).filter(F.expr("at + size(ctx) - span >= 0"))
    found = found.groupBy("_d", "_o").agg(F.collect_list(F.struct("at", "item", "ctx", "span")).alias("cands"))
    x = d.join(found, ["_d", "_o"], "left").withColumn("raw", words_of(F.col("text")))
    x = x.withColumns({"n_words": F.size("raw").cast("long"), "ws": F.when(F.col("cands").isNotNull(), F.transform("raw", lowered))})
    hits = F.expr("""flatten(transform(cands, c -> transform(
        filter(sequence(0, size(c.ctx) - c.span), k -> c.at + k >= 0 and c.at + k + c.span <= size(ws) and slice(ws, c.at + k + 1, c.span) = slice(c.ctx, k + 1, c.span)),
        k -> named_struct('a', c.at + k, 'b', c.at + k + c.span, 'item', c.item))))""")
    x = x.select("_d", "_o", "n_words", F.when(F.col("cands").isNotNull(), hits).alias("hits"))
    spans = F.expr("aggregate(array_sort(array_distinct(transform(hits, h -> named_struct('a', h.a, 'b', h.b)))), named_struct('n', 0, 'upto', 0), (s, h) -> named_struct('n', s.n + greatest(0, h.b - greatest(h.a, s.upto)), 'upto', greatest(s.upto, h.b)), s -> s.n)")
    x = x.select("_d", "_o", "n_words", F.coalesce(spans, F.lit(0)).cast("long").alias("n_hit"), F.expr("array_sort(array_distinct(transform(coalesce(hits, array()), h -> h.item)))").alias("items"))
    return back(x.select("_d", "_o", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), F.expr(f"n_hit > 0 and {share} * n_hit >= n_words").alias("contaminated")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS span, array_to_string(ws[j : j + least(13, len(ws)) - 1], ' ') AS win
    FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS j FROM i WHERE len(ws) > 0)),
spans AS (SELECT DISTINCT span FROM iw),
h AS (SELECT x.doc_id, x.j, x.span, iw.item_id FROM (SELECT doc_id, span, j, array_to_string(ws[j : j + span - 1], ' ') AS win
    FROM (SELECT doc_id, ws, span, unnest(range(1, len(ws) - span + 2)) AS j FROM d, spans WHERE len(ws) >= span)) x JOIN iw USING (span, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + span)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
