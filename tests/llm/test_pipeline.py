import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from jarloom.llm import jaccard, mixing
from jarloom.llm.decontaminate import decontaminate
from jarloom.llm.packing import encoder, tokenizer_file

DOC = "doc_id long, text string, lang string, source string, n_chars long, gone long, _id string, score string"


def tables(spark, path, rows):
    r = random.Random(5)
    spark.createDataFrame([(i, t, "en", s, 0, 7, "x", "y") for i, t, s in rows], DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r.choice(["n1", "n2"]), "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), ("n3", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int("nitwit" in (t or "")), "z") for i, t, _ in rows if i is not None], "doc_id long, toxic int, text string").write.parquet(f"{path}/labels.parquet")


def rows():
    r = random.Random(6)
    some = lambda n: " ".join(r.choice(["th", "er", "on", "an", "re", "he"]) * r.randint(1, 3) + r.choice("aeiou") for _ in range(n))
    out = [(k, some(60) + (" nitwit and nitwit" if k % 4 == 0 else ""), f"s{k % 3}") for k in range(200)]
    kept = [t for _, t, _ in out if "nitwit" not in t]
    copy = kept[3] + " end"
    bench = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"
    return out + [(500, copy, "s0"), (501, bench, "s1"), (502, None, None), (503, "", "s1")], copy, bench


def test_stages_take_effect(spark, tmp_path):
    given, copy, bench = rows()
    tables(spark, tmp_path, given)
    d, docs = f"file://{tmp_path}", None
    seen = spark.read.parquet(f"{d}/documents.parquet")
    by_stage = {}
    for name, stage in P.STAGES:
        out = stage(spark, seen, d)
        if name != "token_id_output":
            assert out.columns == seen.columns
        out.write.parquet(f"{tmp_path}/out-{name}")
        by_stage[name] = (seen, docs := spark.read.parquet(f"{tmp_path}/out-{name}"))
        seen = docs
    text = lambda df: [x.text for x in df.select("text").collect()]
    clean = text(by_stage["toxicity"][1])
    assert sum("nitwit" in (t or "") for t in clean) <= 2 and sum("nitwit" not in (t or "") for t in clean) >= 0.97 * 154
    assert copy not in text(by_stage["ngram_jaccard_join"][1]) and copy in text(by_stage["ngram_jaccard_join"][0])
    before, after = by_stage["benchmark_decontamination"]
    assert set(text(before)) - set(text(after)) == {bench}
    before, after = by_stage["mixing_sources"]
    want = {x.doc_id: x.taken / x.size for x in mixing.mix_sources(before).collect() if x["size"]}
    times = {x.doc_id: x["count"] for x in after.groupBy("doc_id").count().collect()}
    assert all(abs(times.get(k, 0) - v) <= 0.5 for k, v in want.items())
    enc = encoder(tokenizer_file()).tokenizer
    n = {x.doc_id: x.n_tokens for x in by_stage["token_id_output"][1].collect()}
    assert n == {x.doc_id: len(enc.encode(x.text or "", add_special_tokens=False).ids) + 1 for x in after.collect()}
    assert P.run(spark, d).count() == after.count()


def test_rows_that_share_a_doc_id_are_judged_one_by_one(spark, tmp_path):
    a, b = "one two three four five six seven", "quite another text that nobody else has"
    bench = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"
    given = [(1, a, "s"), (1, b, "s"), (1, bench, "s"), (2, a, "s"), (None, b + " x y z", "s"), (None, "more of it", None), (None, None, None)]
    tables(spark, tmp_path, given)
    d = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    near = [r.text for r in P.drop_near_copies(spark, docs, d).collect()]
    assert sorted(map(str, near)) == sorted(map(str, {t for _, t, _ in given}))
    clean = [(r.doc_id, r.text) for r in P.drop_contaminated(spark, docs, d).collect()]
    assert sorted(clean, key=str) == sorted([(i, t) for i, t, _ in given if t != bench], key=str)
    assert P.run(spark, d).count() > 0


def test_empty(spark, tmp_path):
    tables(spark, tmp_path, [(1, "a", "s")])
    d = f"file://{tmp_path}"
    none = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, d).count() == 0


@pytest.mark.parametrize("name", ["drop_near_copies", "drop_contaminated"])
def test_filters_agree_with_their_operators(spark, name):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = {r.doc_id for r in getattr(P, name)(spark, docs, d).select("doc_id").collect()}
    if name == "drop_near_copies":
        want = jaccard.jaccard_components(docs, P.GRAM, P.PERCENT).filter("doc_id = component_id")
    else:
        want = decontaminate(docs, spark.read.parquet(f"{d}/benchmark.parquet")).filter(~F.col("contaminated"))
    assert got == {r.doc_id for r in want.select("doc_id").collect()}


def test_the_mix_shuffles_no_text(spark):
    """A row for each source tells how often its documents are taken, as the operator has it for each of them."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 50 == 1, "one").otherwise(F.col("source")))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 20 == 7, " \t").otherwise(F.col("text")))
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        out = P.mixed(spark, docs, d)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    finally:
        spark.conf.set(key, before)
    want = {r.doc_id: int(r.taken / r.size + 0.5) if r.size else 1 for r in mixing.mix_sources(docs).select("doc_id", "taken", "size").collect() for r in [type("R", (), r.asDict())]}
    assert got == {k: n for k, n in want.items() if n} and len(set(want.values())) > 2
