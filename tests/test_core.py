import hashlib
import lzma

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from jarloom.functions.names import milli, ratio_text
from jarloom.operators import evaluate, similarity
from jarloom.plans import registry
from jarloom.sources import corpus

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "part", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert plain(df.select(*cols).collect()) == plain(db.sql(registry.oracle_sql()[name]).select(*(f'"{c}"' for c in cols)).fetchall())


# (a, b, shared, union, jaccard, inclusion) as printed in published result tables
GOLDEN = [(211, 208, 191, 228, "0.838", "0.905"), (211, 239, 153, 297, "0.515", "0.725"), (211, 114, 34, 291, "0.117", "0.161"), (70, 77, 2, 145, "0.014", "0.029"), (70, 70, 70, 70, "1.000", "1.000")]


def test_published_ratios(spark):
    df = spark.createDataFrame(GOLDEN, "a long, b long, i long, u long, j string, n string")
    i = F.col("i")
    got = df.select((F.col("a") + F.col("b") - i) == F.col("u"), ratio_text(milli(i, F.col("u"))) == F.col("j"), ratio_text(milli(i, F.col("a"))) == F.col("n")).collect()
    assert all(all(r) for r in got)


def test_subjects_without_candidates_and_of_the_same_family(spark):
    subjects = spark.createDataFrame([("h1", "ant-1.0.jar"), ("h2", "ivy-2.0.jar"), ("h3", "log-1.0.jar")], "subject string, name string")
    results = spark.createDataFrame([("h1", 1, 5, 900, "x1", "ANT-1.1.jar"), ("h3", 1, 5, 900, "x2", "ivy-2.1.jar")], "subject string, rank long, a_intersect_b long, jaccard_m long, filesha1 string, artifact string")
    classes = evaluate.classified(results, subjects.select("subject", F.col("subject").alias("target")), subjects)
    assert {r.subject: (r.verdict, r.related_rank) for r in classes.collect()} == {"h1": ("CORRECT", 1), "h2": ("NO_MATCH", None), "h3": ("WRONG", None)}
    assert {r.verdict: r.n for r in evaluate.totals(classes).collect()} == {"CORRECT": 1, "NO_MATCH": 1, "WRONG": 1, "TOTAL": 3}


def rows_of(db, name):
    return set(map(str, db.sql(registry.oracle_sql()[name]).fetchall()))


def test_greens_tell_columns_apart():
    """The derived corpus gives different answers for files, signatures and loose signatures, and every verdict."""
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    bin2bin, filehash, loose, compat = (rows_of(db, n) for n in ("bin2bin_default", "filehash_match", "loose_match", "loose_match_tight_tally"))
    assert bin2bin != filehash and bin2bin != loose and filehash != loose and compat != loose
    matrix = db.sql(registry.oracle_sql()["evaluation_matrix"]).fetchall()
    assert all(sum(r[k] for r in matrix) > 0 for k in range(2, 6))
    for p in (lambda s: [x for x in s if "True" in x],):
        assert p(rows_of(db, "tie_flags"))


def test_subject_filter_is_below_the_join(spark):
    plan = registry.queries()["bin2bin_subject"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_result_tree_is_written(spark, tmp_path):
    results = spark.createDataFrame([("h1", 1, 5, 1000, "h1", "a-1.jar")], "subject string, rank long, a_intersect_b long, jaccard_m long, filesha1 string, artifact string")
    truth = spark.createDataFrame([("h1", "h1"), ("h2", "h2")], "subject string, target string")
    classes = evaluate.classified(results, truth, truth.select("subject", F.lit("a-1.jar").alias("name")))
    evaluate.write_results(results, classes, spark.createDataFrame([("h1", "JAR-SHA1-TRUTH")], "subject string, truth_source string"), f"{tmp_path}/tree")
    got = {(r.subject, r.truth_source, r.folder, r.artifact) for r in spark.read.parquet(f"{tmp_path}/tree").collect()}
    assert got == {("h1", "JAR-SHA1-TRUTH", "SINGLE-PERFECT-1.000", "a-1.jar"), ("h2", "NEW-ANALYSIS", "NO_MATCH", None)}


def test_prepared_tables_give_the_same(spark, tmp_path):
    before = plain(registry.queries()["bin2bin_default"](spark, SF).collect())
    corpus.prepare(spark, SF, f"{tmp_path}/corpus")
    try:
        assert plain(registry.queries()["bin2bin_default"](spark, SF).collect()) == before
    finally:
        corpus.PREPARED.clear()


def test_records_are_read_from_xz_too(spark, tmp_path):
    files, sigs = corpus.derived(spark, SF)
    (tmp_path / "a").mkdir()
    lines = [r.record for r in corpus.sig_records(sigs).collect()]
    (tmp_path / "a/x.txt").write_text("\n".join(lines[:100]) + "\n")
    (tmp_path / "a/y.xz").write_bytes(lzma.compress(("\n".join(lines[100:]) + "\n").encode()))
    got = corpus.parse_records(corpus.read_records(spark, f"{tmp_path}/a"))[1]
    assert plain(got.collect()) == plain(sigs.collect())


def made_corpus(spark):
    """Archives a to d: a has two names, b none with a digit, c and d share all; null places and an archive without classes."""
    names = [("p/", "a-1", "a"), ("q/", "a-1", "a"), (None, "b", "b"), ("p/", "c2", "c"), ("p/", "d2", "d"), ("p/", "e2", "e")]
    kids = [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1"), ("b", "2"), ("c", "1"), ("c", "4"), ("d", "1"), ("d", "4")]
    rows = [(p, n, ".jar", -1, None, h) for p, n, h in names] + [("c/", "x", ".class", 0, h, k) for h, k in kids]
    files = spark.createDataFrame(rows, "path string, basename string, suffix string, level int, infilesha1 string, filesha1 string")
    return files, spark.createDataFrame([(k, f"s{k}") for k in "1234"], "filesha1 string, sigsha1re string")


def test_pairs_with_several_names(spark):
    got = similarity.similarity(*made_corpus(spark), ".class", ".class", versioned=False)
    rows = {(r.subject, r.rank, r.a_intersect_b, r.jaccard, r.filesha1, r.path) for r in got.filter("subject in ('a', 'c')").collect()}
    assert rows == {
        ("a", 1, 3, "1.000", "a", "p/"), ("a", 2, 3, "1.000", "a", "q/"), ("a", 3, 2, "0.667", "b", None), ("a", 4, 1, "0.250", "c", "p/"), ("a", 5, 1, "0.250", "d", "p/"),
        ("c", 1, 2, "1.000", "c", "p/"), ("c", 2, 2, "1.000", "d", "p/"), ("c", 3, 1, "0.333", "b", None), ("c", 4, 1, "0.250", "a", "p/"), ("c", 5, 1, "0.250", "a", "q/"),
    }
    assert {r.filesha1 for r in similarity.similarity(*made_corpus(spark), ".class", ".class").collect()} == {"a", "c", "d"}
    assert similarity.similarity(*made_corpus(spark), ".java", ".java").count() == 0


def test_sums_of_subjects_are_those_of_their_rows(spark):
    made = made_corpus(spark)
    truth = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "x"), ("d", None)], "subject string, target string")
    subjects = spark.createDataFrame([("a", "c2-1.jar"), ("b", "b.jar"), ("c", "d2-0.jar"), ("d", "zz.jar"), ("e", "e2.jar")], "subject string, name string")
    rows = similarity.similarity(*made, ".class", ".class")
    own = evaluate.families(subjects)
    x = similarity.summaries(*made, ".class", ".class", truth=own.join(truth, "subject", "left"))
    assert plain(evaluate.verdicts(own.select("subject").join(x, "subject", "left")).collect()) == plain(evaluate.classified(rows, truth, subjects).collect())
    assert plain(similarity.tie_flags(*made, ".class", ".class").collect()) == plain(evaluate.ties(rows).collect())


@pytest.mark.parametrize("name", ["bin2bin_top3", "filehash_match", "all_pairs_jaccard", "tie_flags", "bin2bin_outside_query"])
def test_no_pair_is_shuffled(spark, name):
    """Pairs arise in the last stage: nothing above them moves rows."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and not any(x in top for x in ("Window", "Join", "Aggregate", "Repartition", "Sort"))


def test_names_go_to_blocks_packed(spark):
    """A block gets names in a few compressed rows, not a row for each: nothing that has an artifact in it is multiplied by the blocks or dealt out to them."""
    names = spark.range(20_000).select(F.col("id"), F.lit(1).cast("long").alias("n"), F.concat(F.lit("a-"), "id").alias("artifact"), F.sha1(F.col("id").cast("string")).alias("filesha1"), F.lit("p/").alias("path"), F.lit(None).cast("string").alias("low")).coalesce(1)
    rows = similarity.packed(names).collect()
    assert len(rows) == 1 and sum(len(r.names) for r in rows) < 0.6 * 20_000 * (8 + 8 + 7 + 40 + 2)
    back = pa.concat_tables([pa.ipc.open_stream(r.names).read_all() for r in rows])
    assert sorted(map(tuple, (x.values() for x in back.to_pylist()))) == sorted(map(tuple, names.collect()))
    plan = registry.queries()["all_pairs_jaccard"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and not any("artifact" in x for x in plan.split("\n") if "Generate" in x or "RepartitionById" in x)
    assert "artifact" not in "".join(x for x in plan.split("MapInArrow")[1].split("\n") if "Project" in x or "Union" in x)


def block_of(n):
    """n archives that are subjects too, all with the same two signatures."""
    fields = [f.split(" ", 1)[0] for f in similarity.SENT.split(", ")]
    sink = pa.BufferOutputStream()
    names = pa.table([list(range(n)), [2] * n, [f"a-{k:05d}" for k in range(n)], [f"h{k}" for k in range(n)], ["p/"] * n, [None] * n], similarity.NAMES)
    with pa.ipc.new_stream(sink, names.schema) as out:
        out.write_table(names)
    rows = [{"kind": 0, "names": sink.getvalue().to_pybytes()}] + [{"kind": 1, "id": k, "n": 2, "filesha1": f"h{k}"} for k in range(n)] + [{"kind": 2, "asked": list(range(n)), "held": list(range(n))}] * 2
    types = {"block": pa.int32(), "kind": pa.int32(), "id": pa.int64(), "n": pa.int64(), "asked": pa.list_(pa.int64()), "held": pa.list_(pa.int64()), "names": pa.binary()}
    return similarity.Block(pa.Table.from_pylist(rows, pa.schema([(f, types.get(f, pa.string())) for f in fields])), "jaccard")


def test_no_more_is_held_than_is_given():
    """Rows of many subjects make a batch: of one that gives a few rows nothing else may be held until then."""
    block, held = block_of(300), []
    ranked = block.ranked
    block.ranked = lambda *a: held.append(x := ranked(*a)) or x
    rows = pa.Table.from_batches(similarity.give_rows(block, 2)).to_pylist()
    assert len(held) == 300 and sum((v if v.base is None else v.base).nbytes for x in held for v in x.values()) <= 300 * 2 * 8 * len(held[0])
    assert [(r["subject"], r["rank"], r["filesha1"]) for r in rows] == [(f"h{s}", k + 1, f"h{k}") for s in range(300) for k in range(2)]


@pytest.mark.parametrize("n", [7, 10])
def test_sums_that_are_null_in_a_whole_batch(monkeypatch, n):
    """Subjects without a family have no related rank: a full batch of them has the columns' types, as the last one has."""
    monkeypatch.setattr(similarity, "BATCH", 5)
    got = list(similarity.give_classes(block_of(n), None))
    assert [b.num_rows for b in got] == [5, n - 5] and all(b.schema.types == [pa.string(), *[pa.int64()] * 6] for b in got)
    assert pa.Table.from_batches(got)["related_rank"].null_count == pa.Table.from_batches(got)["hit_rank"].null_count == n


def test_rows_of_like_subjects_go_by_candidate(tmp_path):
    """Whole results in an order that Parquet files hold in little room: a candidate's rows follow one another, whatever part it is in."""
    n, parts = 600, []
    for k in range(2):
        parts.append(pa.Table.from_batches(similarity.give_rows(block_of(n), None, k, 2)))
        pq.write_table(parts[-1], tmp_path / f"{k}.parquet")
        names = parts[-1]["filesha1"].to_pylist()
        assert sum(a != b for a, b in zip(names, names[1:], strict=False)) == len(set(names)) - 1 < n
    assert {(r["subject"], r["rank"], r["filesha1"], r["jaccard"]) for p in parts for r in p.to_pylist()} == {(f"h{s}", k + 1, f"h{k}", "1.000") for s in range(n) for k in range(n)}
    assert sum(p.num_rows for p in parts) == n * n
    assert sum(p.stat().st_size for p in tmp_path.iterdir()) < 0.5 * n * n


@pytest.mark.parametrize("rows", [3, 1_000_000])
def test_parts_and_groups_of_any_size_give_the_same(monkeypatch, rows):
    block = block_of(23)
    whole = plain(tuple(r.values()) for b in similarity.give_rows(block, 10**9) for r in b.to_pylist())
    monkeypatch.setattr(similarity, "GROUP", rows)
    assert plain(tuple(r.values()) for k in range(3) for b in similarity.give_rows(block, None, k, 3) for r in b.to_pylist()) == whole


def test_pairs_are_dealt_out_once(spark):
    """Sets, askers and counts come of one shuffle by signature, and children are not joined with signatures that their lines give."""
    df = registry.queries()["bin2bin_top3"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    assert sum("REPARTITION_BY_COL" in x and "ReusedExchange" not in x for x in plan) == 1 and any("REPARTITION_BY_COL" in x and "ReusedExchange" in x for x in plan)
    assert not any("Exchange hashpartitioning(filesha1" in x and "REPARTITION" in x for x in plan)
    assert sum("Join" in x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n")) == 3  # of sets, counts of subjects, counts of names


@pytest.mark.parametrize("col", ["sigsha1re", "filesha1"])
def test_children_with_signatures_beside_them_give_the_same(spark, col):
    """With null signatures too: one counts, but is shared with nobody."""
    files, sigs = made_corpus(spark)
    sigs = sigs.withColumn("sigsha1re", F.when(F.col("sigsha1re") != "s4", F.col("sigsha1re")))
    rows = plain(similarity.similarity(files, sigs, ".class", ".class", col=col, versioned=False).collect())
    assert rows == plain(similarity.similarity(files, sigs, ".class", ".class", col=col, versioned=False, kids=files.join(sigs, "filesha1")).collect())
    assert ("('c', 1, 2, 2, 1, 3," in "".join(rows)) == (col == "sigsha1re")


def test_truth_moves_lines_once(spark, tmp_path):
    """A line's archives are dealt out once, and only those that a greater one shares a line with are ranked among them."""
    df = registry.truth_list_lines(spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in x for x in plan.split("\n")) == 1 and "Window" in plan
    docs = [(1, "a\nb"), (5, "b\nc"), (13, "\n\n"), (21, ""), (25, "c"), (29, "lone"), (37, "lone")]
    spark.createDataFrame([(k, "en", "s", t) for k, t in docs], "doc_id long, lang string, source string, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    h = {k: hashlib.sha1(t.encode()).hexdigest() for k, t in docs}
    got = {r.value.split(";")[2]: r.value.split(";")[3] for r in registry.truth_list_lines(spark, str(tmp_path)).collect() if ";" in r.value}
    assert got == {h[1]: max(h[1], h[5]), h[5]: max(h[1], h[5], h[25]), h[13]: "", h[21]: "", h[25]: max(h[5], h[25]), h[29]: h[29]}


def test_lines_are_not_shuffled(spark):
    files, sigs = corpus.derived(spark, SF)
    plan = similarity.members(files, sigs, ".class")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("line" in x for x in plan.split("\n") if "Aggregate" in x and "sha1" not in x)
    assert "classname" not in plan and "basename" not in plan
