"""Record files that arrive over time, into the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.corpus import FILES, SIGS, parse_records


def append_new(new: DataFrame, path: str, schema: str) -> None:
    """Append the different rows that the table does not have. Of the table only rows with the batch's file hashes are compared, so a batch that is run again adds nothing."""
    new = new.distinct()
    old = new.sparkSession.read.schema(schema).parquet(path).join(new.select("filesha1").distinct(), "filesha1", "left_semi")
    new.subtract(old.select(*new.columns)).write.mode("append").parquet(path)


def ingest(spark: SparkSession, folder: str, corpus: str, checkpoint: str, per_batch: int = 1000) -> StreamingQuery:
    """Read text files of F and S records from a folder as they come, `per_batch` files at a time, into corpus/files and corpus/sigs, tables of different rows. Ends when all files that are there have been read."""
    tables = {f"{corpus}/files": FILES, f"{corpus}/sigs": SIGS}
    for path, schema in tables.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)

    def add(batch: DataFrame, _: int) -> None:
        for df, (path, schema) in zip(parse_records(batch), tables.items(), strict=True):
            append_new(df, path, schema)

    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", per_batch).text(folder).select(F.col("value").alias("record"))
    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
