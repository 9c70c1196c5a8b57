"""The corpus pipeline: documents through five of the operators, each stage written and read again.

Stages take whole rows. A row is known by its doc_id, or, where doc_ids are null or repeat, by a number of its own, so that rows which share a doc_id are judged one by
one. Every stage gives no rows for an empty table; other columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jarloom.llm.common import dropped, read, saved
from jarloom.llm.decontaminate import bounded, decontaminate
from jarloom.llm.jaccard import jaccard_components
from jarloom.llm.mixing import mix_key, mix_sources
from jarloom.llm.packing import pack_tokens, tokenizer_file, unpacked
from jarloom.llm.toxicity import toxicity

GRAM, PERCENT = 3, 90  # of near copies, as in the contract of the operator; 5 and 80 take more disk than a stage may (see the README)


def rows_of(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column, and its name, that tells rows apart: doc_id where these are all different, else a number of the row, saved, as it would not come out the same twice."""
    row = "row"
    while any(c.lower().startswith(row) for c in docs.columns):
        row += "_"
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long")), row
    return saved(docs.withColumn(row, F.monotonically_increasing_id()), "pipe-rows"), row


def by_row(docs: DataFrame, row: str) -> DataFrame:
    """What operators get: the row in place of doc_id."""
    return docs.withColumn("doc_id", F.col(row)).drop(row)


def without(docs: DataFrame, row: str, found: DataFrame) -> DataFrame:
    """docs without the rows that found has the doc_ids of; these are broadcast only if they are few by count."""
    gone = saved(found.select(F.col("doc_id").alias(row)), "pipe-gone")
    return docs.join(bounded(gone), row, "left_anti").select(*(c for c in docs.columns if c != row))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not predict to be toxic. A null or empty text has the score of no insult and stays."""
    return toxicity(docs, read(spark, sf_dir, "labels")).filter("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (GRAM words, PERCENT of similarity) the row with the smallest doc_id, or the first read where doc_ids repeat. Texts without words
    are linked with nothing and stay."""
    docs, row = rows_of(docs)
    return without(docs, row, jaccard_components(by_row(docs, row), GRAM, PERCENT).filter("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. A null text has no words and stays."""
    docs, row = rows_of(docs)
    found = saved(decontaminate(by_row(docs, row), read(spark, sf_dir, "benchmark")), "pipe-hits")  # else the filter is worked out from copies of the whole expression
    return without(docs, row, found.filter("contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, as rows that repeat. The one at a source's cut is taken whole if half of it or more is inside the budget; one without
    words costs nothing and is taken once.

    In the order of the mix a source's documents up to some place are taken once more than those behind it, so a row for each source tells how often, and no text is
    shuffled to meet its number.
    """
    names = docs.columns
    docs, row = rows_of(docs)
    own = by_row(docs, row)
    place = F.struct(mix_key(F.col("doc_id")).alias("key"), F.col("doc_id").alias("id"))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    per = mix_sources(own).filter("size > 0").select(F.col("source").alias(f"{row}_s"), place.alias("place"), times.alias("n"))
    last = F.max(F.struct("n", "place"))  # of those that are taken most often, the last one
    per = saved(per.groupBy(f"{row}_s").agg(last.alias(f"{row}_last"), F.min("n").alias(f"{row}_n")), "pipe-times")  # a row for each source
    x = docs.join(bounded(per), F.col("source").eqNullSafe(F.col(f"{row}_s")), "left")
    here = F.struct(mix_key(F.col(row)).alias("key"), F.col(row).alias("id"))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    n = F.when(~words, 1).otherwise(F.when(here <= F.col(f"{row}_last.place"), F.col(f"{row}_last.n")).otherwise(F.col(f"{row}_n")))
    return x.withColumn(f"{row}_t", n).filter(F.col(f"{row}_t") > 0).select(*names, F.explode(F.sequence(F.lit(1), F.col(f"{row}_t"))).alias(f"{row}_k")).select(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed files, and what reading these back gives for each row. A null text is empty; rows that share a doc_id stand by their text."""
    return unpacked(pack_tokens(docs, tokenizer_file()))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("benchmark_decontamination", drop_contaminated), ("mixing_sources", mixed), ("token_id_output", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read as the next one's docs, which then goes; an empty table gives no rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"pipe-{name}")
        if hasattr(before, "saved_at"):
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
