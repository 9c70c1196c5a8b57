"""What the operators share: the shared folder, keys of documents, word hashes, interval removal."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = -(2**63)  # stands for a null id, before all others
U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 512, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut by rows and by bytes of a column (or one row): what Python objects are made of at a time."""
    for b in batches:
        size = np.zeros(b.num_rows + 1, np.int64)
        np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False), out=size[1:])
        a = 0
        while a < b.num_rows:
            e = min(a + rows, max(a + 1, int(np.searchsorted(size, size[a] + most, side="right")) - 1))
            yield b.slice(a, e - a)
            a = e
    give_back()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where none is set, a temporary one if all runs in this process (master local), as in tests; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="jarloom-")
        atexit.register(shutil.rmtree, found, True)
        found = f"file://{found}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


TABLES: dict[str, SparkSession] = {}  # paths of the tables that saved() has written and nothing has dropped


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """While it lasts, Arrow batches have at most so many rows (null: as the session has it). What is executed inside is bounded by it; the session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(rows or before))
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, name: str, compression: str = "zstd", rows: int | None = None, tasks: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and any executor can be lost. It stays until dropped(), released() or the end of the process.

    rows bounds Arrow batches on the way: texts in a batch are held several times over, by the JVM outside its heap and by Python. tasks bounds how many tasks write, and so the
    files, for each of which Hadoop's local file system starts processes (see held()).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    TABLES[path] = spark
    with batches_of(spark, rows):
        (df.coalesce(tasks) if tasks else df).write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def held(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """As saved(), but on the executors' own disks, through Spark's cache: what a lost executor held is worked out anew. No file is written to a file system, for each of which
    Hadoop's local one starts a process that for a moment counts as large as the executor."""
    with batches_of(df.sparkSession, rows):
        out = df.persist(StorageLevel.DISK_ONLY)
        out.count()
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that saved() wrote or held() holds and that nothing will read any more."""
    for t in tables:
        if hasattr(t, "saved_at"):
            delete(t.saved_at)
        else:
            t.unpersist()


def delete(path: str) -> None:
    spark = TABLES.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def released() -> None:
    """Delete all tables of this process; results that read them can't be used afterwards."""
    for path in list(TABLES):
        try:
            delete(path)
        except Exception:  # the session has ended before
            TABLES.pop(path, None)


def with_keys(docs: DataFrame) -> DataFrame:
    """docs with only _d (doc_id; LEAST for null), _o (0; -1 where doc_id is null) and text (empty for null).

    Rows that share a doc_id are documents of their own: where there are any, _o numbers all rows as they are read, below 0 where doc_id is null, and the table is saved
    with these numbers, as they would not come out the same twice. Nothing is sorted, so any number of rows may share an id.
    """
    null = F.col("doc_id").isNull()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(LEAST)).alias("_d")
    if d.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return d.select(key, F.when(null, F.lit(-1)).otherwise(F.lit(0)).cast("long").alias("_o"), "text")
    n = F.monotonically_increasing_id()
    return saved(d.select(key, F.when(null, -1 - n).otherwise(n).alias("_o"), "text"), "keyed")


def back(df: DataFrame) -> DataFrame:
    """_d and _o to doc_id again."""
    return df.withColumn("doc_id", real()).drop("_d", "_o")


def real() -> Column:
    """doc_id: _d, unless that stands for null."""
    return F.when(F.col("_o") >= 0, F.col("_d"))


class Hashes(dict):
    """64-bit hashes of byte words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


HASHES = Hashes()


IN_USE: dict = {}


def in_use(name: str, release) -> None:
    """One operator's memory of words at a time in a Python worker: what another one held is released when this one begins."""
    if IN_USE.get("name") != name:
        IN_USE.get("release", lambda: None)()
        IN_USE.update(name=name, release=release)
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory to the system: Arrow's and C's allocators keep it, and a Python worker lives as long as there are tasks for it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only GNU's library has it
        trim(0)


def word_hashes(words: list[bytes]) -> np.ndarray:
    in_use("hashes", HASHES.clear)
    return np.fromiter(map(HASHES.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64's constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def union_length(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """A mask over n places: True inside any [start, end)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, np.minimum(start, n), 1)
    np.add.at(d, np.minimum(end, n), -1)
    return np.cumsum(d[:n]) > 0


def hexdigest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """Rows with the greatest c, all of one count or none of them, at most `most`. What comes to the driver is a histogram of counts, in logarithmic steps above 1000."""
    step = F.when(F.col("c") <= 1000, F.col("c")).otherwise(1000 + F.floor(F.log2(F.col("c") / 1000) * 64)).cast("long")
    least, upto = None, 0
    for s, n in sorted(table.groupBy(step.alias("s")).count().collect(), reverse=True):
        if (upto := upto + n) > most:
            break
        least = s
    return table.filter(F.lit(False) if least is None else step >= least)


def components(links: DataFrame, name: str = "cc", tasks: int | None = None) -> DataFrame:
    """links (a, b) to (id, comp, ...): the smallest id that links reach. Ids without links are not in it.

    Each round every id takes the least label around it and then that label's own label; tables go to the shared folder between rounds.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), f"{name}-links", tasks=tasks)
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), f"{name}-0", tasks=tasks)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "id").select("id", F.least("comp", "m").alias("new"), "comp")
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("top"))
        after = saved(step.join(jump, "new", "left").select("id", F.least("new", F.coalesce("top", "new")).alias("comp"), F.col("comp").alias("was")), f"{name}-n", tasks=tasks)
        dropped(labels)
        if after.filter("comp <> was").isEmpty():
            dropped(both)
            return after
        labels = after
