"""Times the headline queries over the corpus tables, written once, and prints one JSON line.

Queries run once before they are timed: what a cluster that is up needs for them, without the start of the JVM and of code generation. Writing the tables is timed
too, as corpus_build.
"""

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from jarloom.plans import registry
from jarloom.sources import corpus

HEADLINE = ["tallies_update_all", "table_counts", "bin2bin_default", "src2src", "all_pairs_jaccard", "internal_match", "bin2bin_subject", "binary_without_source", "exact_hash_lookup", "classify_results", "evaluation_matrix"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, times, folder = registry.queries(), {}, tempfile.mkdtemp(prefix="jarloom-bench-")
    run = lambda name: found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    try:
        began = time.time()
        corpus.prepare(spark, sf_dir, f"file://{folder}")
        times["corpus_build"] = round(time.time() - began, 3)
        for name in HEADLINE:
            run(name)
            began = time.time()
            run(name)
            times[name] = round(time.time() - began, 3)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
