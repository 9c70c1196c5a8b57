import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jarloom.llm import chat, common, jaccard, lattice, mixing, neighbours, packing, recompress, repeats, suffixes, toxicity
from jarloom.llm.decontaminate import decontaminate

DOC = "doc_id long, text string, lang string, source string, n_chars long, text2 string, score string, a long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", None if k % 3 == 0 else f"s{k % 3}", 0, "x", "y", 1) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))], DOC)


def copies(seed=4, n=40):
    r = random.Random(seed)
    base = [[r.choice("abcdefghijkl") * r.randint(1, 9) + str(r.randint(0, 40)) for _ in range(r.choice([3, 30, 60, 200]))] for _ in range(6)]
    out = [None, "", " ", "a", "a a", "x " * 400, "y" * 5000, "y" * 300]
    for _ in range(n):
        x = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            x[r.randrange(len(x))] = "new" + str(r.random())
        out.append(" ".join(r.choice(base) * r.choice([0, 1]) + x))
    return out


def test_recompression(spark):
    texts = copies()
    words = [(t or "").encode().split() for t in texts]
    seen: dict = {}
    for w in words:
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    got = {r.doc_id: r for r in recompress.repeated_words(frame(spark, texts)).collect()}
    for i, w in enumerate(words):
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_suffixes(spark):
    texts = copies(9)
    seen, got = set(), {r.doc_id: r for r in suffixes.repeated_bytes(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone |= set(range(k, k + 100))
            seen.add(b[k : k + 100])
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest())


def brute_bytes(texts):
    seen, out = set(), []
    for t in texts:
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone |= set(range(k, k + 100))
            seen.add(b[k : k + 100])
        out.append((len(b), len(gone), hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [1_000_000, 3000])
def test_frequent_content(spark, monkeypatch, group):
    """With frequent keys found in the sample, a line between others, a passage in many texts, periodic text, and groups that are too large for a task."""
    monkeypatch.setattr(repeats, "SAMPLE_PART", 1)
    monkeypatch.setattr(repeats, "HOT_LEAST", 3)
    monkeypatch.setattr(suffixes, "GROUP_BYTES", group)
    monkeypatch.setattr(suffixes, "SPLIT_ROWS", 10)
    r = random.Random(8)
    some = lambda n: " ".join(r.choice("abcdefghijkl") * r.randint(1, 3) + str(r.randint(0, 99)) for _ in range(n))
    line, passage, other = some(9), some(60), some(40)
    texts = [" ".join([some(40), line, some(40)]) for _ in range(30)] + [" ".join([some(r.randint(0, 50)), passage, r.choice([other, some(50)])]) for _ in range(30)]
    texts += ["ab cd " * 100, "ab cd " * 30 + passage, passage, passage, "z" * 700]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.kept_sha256) for x in suffixes.repeated_bytes(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == brute_bytes(texts)
    words, seen = [t.split() for t in texts], {}
    for w in words:
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    got = {x.doc_id: (x.n_words, x.n_removed) for x in recompress.repeated_words(frame(spark, texts)).collect()}
    for i, w in enumerate(words):
        assert got[i] == (len(w), len({p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)})), i


def test_suffix_array():
    r = random.Random(1)
    for _ in range(800):
        s = [r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(0, 40))]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_jaccard(spark):
    texts = copies(5, 60)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    top = list(range(len(sets)))
    for _ in sets:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 90 * len(x | y):
                    top[i] = min(top[i], top[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert got == {i: (len(s), top[i]) for i, s in enumerate(sets)}


def test_jaccard_files(spark, monkeypatch):
    """However many partitions the session has, a table is written by few tasks: for each file Hadoop's local file system starts processes."""
    files, settings = [], {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    monkeypatch.setattr(common, "delete", lambda path: files.append(len(spark.read.parquet(path).inputFiles())))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert jaccard.jaccard_components(frame(spark, copies(5, 60))).count() == len(copies(5, 60))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files and max(files) <= 12


def test_packing(spark):
    enc, texts = packing.encoder(packing.tokenizer_file()), [None, "", "Don't. stop,now 3.14 ...!!", "É T̈ <|endoftext|> x", "ABC's b c"]
    got = {r.doc_id: r for r in packing.unpacked(packing.pack_tokens(frame(spark, texts), packing.tokenizer_file())).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), packing.zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_encoder_words():
    """Marks in a row leave the words beside them as they are elsewhere, and words encoded together have the ids that they have alone, special tokens' strings among them."""
    enc = packing.Encoder(packing.tokenizer_file())
    assert enc.mark
    ids = lambda t: [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 1]
    texts = ["été*** was&&& été Was!!", "was... it's!?", "<|STARTOFTEXT|> a<|startoftext|>b c** <|endoftext|>", "a** ×b", "", "é** e\u0301** x\x01!! y"]
    got, n = enc([t.encode() for t in texts[:2]], 1)
    assert got.tolist() == ids(texts[0]) + ids(texts[1])
    assert set(enc.index) == {w.encode() for w in ("été", "***", "was", "&&&", "!!", "...", "it", "'s", "!?")}
    got, n = enc([t.encode() for t in texts], 1)
    assert [x.tolist() for x in np.split(got, np.cumsum(n)[:-1])] == list(map(ids, texts))


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17])
def test_bits(bits):
    x = np.random.default_rng(0).integers(0, 2**bits, 150_003, dtype=np.uint64).astype(np.uint32)
    r = packing.Record(packing.write_record([1, None], [3, 150_000], x, bits))
    assert (r.ids() == x).all() and (r.ids(65_530, 131_080) == x[65_530:131_080]).all()


def test_chat(spark):
    rows = [(1, 0, "user", chat.HOSTILE), (1, 1, "assistant", "#### <turn>\\."), (2, 0, "assistant", None), (2, 0, None, "x"), (None, 5, "tool:<turn>", "é")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    order = {1: rows[:2], 2: [rows[3], rows[2]], None: rows[4:]}
    for c, turns in order.items():
        digest = hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns).encode()).hexdigest()
        said = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        assert (got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (digest, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[1].errors == 0 and got[2].errors > 0


def test_lattice_sums_all_segmentations():
    m = lattice.Lattice([b"a", b"b", b"ab", b"a", b"b", b"ab"], [False, False, False, True, True, True])
    m.scores = np.log(np.array([0.1, 0.2, 0.05, 0.3, 0.25, 0.1]))
    assert np.allclose(10 ** m.log10([b"ab", b"aab"]), [0.1 + 0.1 * 0.25, 0.1 * 0.1 * 0.25 + 0.1 * 0.1])
    long = b"ab" * 50
    assert np.isclose(m.log10([long])[0], m.scalar(long)[0][-1] / np.log(10))


def test_neighbours(spark):
    x = np.random.default_rng(2).standard_normal((300, 16)).round(3)
    x[40:60] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [1.0])]
    got = neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    hit = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        best = sorted((k for k in range(300) if k != q), key=lambda k: (-round(s[k], 9), k))[:20]
        hit += len(set(best) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 300 and hit >= 270


def test_toxicity(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(r.randint(1, 4)))
    texts = [" ".join([word() for _ in range(30)] + ([r.choice(["blockhead", "nitwit"])] * 2 if k % 4 == 0 else [])) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    docs = frame(spark, [*texts, None, "n i t w i t " + word(), "nit.wit " + word()])
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).select("doc_id", "score", "predicted").collect()}
    assert sum(got[k].predicted == int(k % 4 == 0) for k in range(400)) > 390
    assert got[400].predicted == 0 and got[401].predicted == 1 and got[402].predicted == 1


def test_empty_tables(spark):
    none, labels = frame(spark, ["x"]).limit(0), spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (recompress.repeated_words(none), suffixes.repeated_bytes(none), jaccard.jaccard_components(none), packing.unpacked(packing.pack_tokens(none, packing.tokenizer_file())), mixing.mix_sources(none), decontaminate(none, items), toxicity.toxicity(none, labels), lattice.lattice_scores(none, packing.tokenizer_file())):
        assert out.count() == 0
    assert decontaminate(frame(spark, ["a b c", None]), items).filter("contaminated").count() == 0


def test_mixing_spends_budgets(spark):
    got = mixing.mix_sources(frame(spark, ["w " * (k % 7) for k in range(300)])).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("m")).collect()
    assert all(abs(r.t - r.m) <= 1 for r in got)


def test_toxicity_finds_each_languages_insults(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).filter("held_out and text is not null").join(labels, "doc_id")
    got = {(r.lang, r.toxic): r for r in got.groupBy("lang", "toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("found")).collect()}
    for lang in ("de", "en", "es", "fr"):
        assert got[lang, 1].found >= 0.3 * got[lang, 1].n, lang
        assert got[lang, 0].found <= 0.05 * got[lang, 0].n, lang


def test_toxicity_learns_from_rare_languages(spark):
    known = spark.createDataFrame([(k, int(k % 2)) for k in range(4000)], "doc_id long, toxic int")
    docs = known.select("doc_id", F.lit("x").alias("text"), F.when(F.col("doc_id") < 60, "aa").otherwise("bb").alias("lang"))
    got = {(r.toxic, r.stratum): r["count"] for r in toxicity.sample(docs, known, {1: 100, 0: 2000}).groupBy("toxic", "stratum").count().collect()}
    assert got[1, "aa"] >= 25 and 95 <= got[1, "aa"] + got[1, "bb"] <= 100
    assert (got[0, "aa"], got[0, "bb"]) == (30, 1970)


def ten_nearest(x, q, k=20):
    s = x @ x[q]
    return set(sorted((j for j in range(len(x)) if j != q), key=lambda j: (-round(s[j], 9), j))[:k])


def test_neighbours_over_many_cells(spark, monkeypatch):
    """64 cells, and queries in several blocks: what is near lies in few of them when vectors are in groups; recall stays above 0.9."""
    monkeypatch.setattr(neighbours, "CELL", 32)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 30)
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 24))
    x = centres[r.integers(0, 40, 2000)] + 0.1 * r.standard_normal((2000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    seen = []
    monkeypatch.setattr(neighbours, "saved", lambda df, name, *a, f=neighbours.saved, **b: (out := f(df, name, *a, **b), seen.append(out.count()) if name == "ann-asked" else None)[0])
    rows = neighbours.neighbours(spark.createDataFrame([(k, v.tolist(), "clash") for k, v in enumerate(x)], "vec_id long, embedding array<double>, cell string")).collect()
    hit = sum(len(ten_nearest(x, q) & {r.vec_id for r in rows if r.query_id == q}) for q in range(0, 2000, 20))
    assert len(rows) == 2000 and hit >= 0.9 * 2000
    assert sum(seen) < 0.6 * 100 * 64  # of all pairs of queries and cells


def test_neighbours_of_nothing_and_of_repeated_ids(spark):
    schema = "vec_id long, embedding array<double>"
    assert neighbours.neighbours(spark.createDataFrame([], schema)).count() == 0
    got = neighbours.neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (None, [5.0, 5.0])], schema)).collect()
    assert {(r.query_id, r.vec_id, r.score) for r in got} == {(0, 1, 1.0), (0, 1, 2.0)}


def test_tokens_by_position(spark, monkeypatch):
    monkeypatch.setattr(packing, "RECORD_IDS", 5)
    texts = [f"word{k} and more of it" for k in range(40)]
    packed = packing.pack_tokens(frame(spark, texts), packing.tokenizer_file())
    enc = packing.encoder(packing.tokenizer_file()).tokenizer
    every = [i for t in texts for i in [*enc.encode(t, add_special_tokens=False).ids, 1]]
    got = sorted((r.start, r.ids) for r in packing.tokens(packed, 17, 61).collect())
    assert got[0][0] == 17 and [i for _, ids in got for i in ids] == every[17:61]


def test_empty_conversations(spark):
    assert chat.read_back(chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


LONG = ("lorem ipsum dolor sit amet consectetur " * 30_000)[:1_000_000]


def test_repeated_and_null_ids_and_long_texts(spark):
    """Rows that share a doc_id, or have none, are documents of their own in every operator; a text of 1 MB and a token of 10 kB are like any others."""
    a, b = " ".join(f"w{k}" for k in range(80)), " ".join(f"v{k}" for k in range(80))
    texts, ids = [a, b, a, a + " end", LONG, "z" * 10_000 + " " + a, None, b], [1, 1, 2, None, -(2**63), 3, None, None]
    docs = frame(spark, texts, ids)
    key = lambda rows, *c: sorted((str(r.doc_id), *(r[x] for x in c)) for r in rows)
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for w in words:
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    gone = [len({p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}) for w in words]
    assert key(recompress.repeated_words(docs).collect(), "n_words", "n_removed") == sorted((str(i), len(w), g) for i, w, g in zip(ids, words, gone, strict=True))
    cut = suffixes.repeated_bytes(docs).collect()
    assert key(cut, "n_bytes") == sorted((str(i), len((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    # which of equal rows is the earlier one is open, but not how much is left of all: one copy of each passage
    assert sum(r.n_removed for r in cut) == sum(x[1] for x in brute_bytes(texts))
    near = {(str(r.doc_id), r.n_shingles): str(r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert near[("2", 78)] == "1" and near[("None", 79)] == "1" and near[("None", 0)] == "None" and near[("-9223372036854775808", len({tuple(words[4][k : k + 3]) for k in range(len(words[4]) - 2)}))] == "-9223372036854775808"
    scored = lattice.lattice_scores(docs, packing.tokenizer_file(), 1).collect()
    assert key(scored, "n_tokens") == sorted((str(i), len(w) + 1) for i, w in zip(ids, words, strict=True))
    assert all(r.held_out for r in scored if r.doc_id is None)
    items = spark.createDataFrame([("i", a, 1), ("i", a, 2), (None, "v1 v2 v3", 3)], "item_id string, text string, w long")
    hits = key(decontaminate(docs, items).collect(), "n_words", "n_hit", "n_items")
    assert hits == sorted([("1", 80, 80, 1), ("1", 80, 3, 1), ("2", 80, 80, 1), ("None", 81, 80, 1), ("-9223372036854775808", len(words[4]), 0, 0), ("3", 81, 80, 1), ("None", 0, 0, 0), ("None", 80, 3, 1)])
    packed = packing.unpacked(packing.pack_tokens(docs, packing.tokenizer_file())).collect()
    assert len(packed) == 8 and len({r.start for r in packed}) == 8
    mixed = mixing.mix_sources(docs).collect()
    assert key(mixed, "size") == sorted((str(i), len(w)) for i, w in zip(ids, words, strict=True)) and all(r.taken <= 3 * r["size"] for r in mixed)
    labels = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (3, 0, "y"), (None, 1, "y"), (2, None, "y")], "doc_id long, toxic int, text string")
    assert toxicity.toxicity(docs, labels).count() == 8


@pytest.mark.parametrize("name", ["op8_mix_sources", "op9_decontaminate"])
def test_against_sql(spark, name):
    import duckdb

    from jarloom.llm import registry

    d, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = registry.queries()[name](spark, d)
    cols = sorted(df.columns)
    plain = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert plain(df.select(*cols).collect()) == plain(db.sql(registry.oracle_sql()[name]).select(*(f'"{c}"' for c in cols)).fetchall())


def test_lattice_columns(spark):
    import math
    import zlib

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
    words = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in rows}
    count = {}
    for i, ws in words.items():
        for w in ws if not out[i] else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for r in lattice.lattice_scores(spark.read.parquet(f"{d}/documents.parquet"), packing.tokenizer_file()).collect():
        ws = words[r.doc_id]
        base = sum(math.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(w in count for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_kernel_by_brute_force():
    """The gap-weighted subsequence kernel by its definition, and the machine's folded weights against it."""
    import itertools

    def brute(a, b):
        def feature(u):
            f = {}
            for at in itertools.combinations(range(len(u)), toxicity.ORDER):
                s = bytes(u[k] for k in at)
                f[s] = f.get(s, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
            return f

        x, y = feature(a), feature(b)
        dot = lambda p, q: sum(w * q.get(s, 0) for s, w in p.items())
        return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))

    import math

    units = [toxicity.code(w) for w in ("idiot", "idxiot", "nitwit", "tidies", "abcdefghijk", "moron")]
    got = toxicity.kernel(units, units[:3])
    assert np.allclose(got, [[brute(a, b) for b in units[:3]] for a in units], atol=1e-5)
    model = toxicity.Model()
    alpha = [0.5, -1.0, 2.0]
    for (which, m), in [((w, m),) for w, m in toxicity.by_length(units[:3])]:
        ids, w, norm = toxicity.subsequences(m)
        for k, row, z in zip(which, ids, norm, strict=True):
            np.add.at(model.theta, row, np.float32(alpha[k]) * (w / z).astype(np.float32))
    model.bias = 0.25
    assert np.allclose(model.values(units), got @ alpha + 0.25, atol=1e-4)
    assert np.allclose(toxicity.Model.unpack(*model.pack()).values(units), model.values(units))


def test_no_vector_comes_to_the_driver(spark, monkeypatch):
    """The tree is fitted on projections that are made where the vectors are, of a sample drawn by a hash."""
    frames, plain = [], type(spark.range(1)).toPandas
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda df: frames.append(out := plain(df)) or out)
    monkeypatch.setattr(neighbours, "SAMPLE", 200)
    df = spark.range(1000).selectExpr("id as vec_id", "transform(sequence(1, 16), k -> cast(hash(id, k) as double)) as embedding")
    got = neighbours.neighbours(df, every=100, k=5)
    assert got.count() == 50
    assert [f.shape[1] for f in frames] == [neighbours.DIMS] and 100 < len(frames[0]) < 300


def test_recompression_writes_no_tables(spark):
    """Each file that an executor writes starts a process that counts as large as the executor: op4 keeps its tables in Spark's cache instead, and frees those that it is done with."""
    from jarloom.llm import common

    words = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, f"a {words} b"), (2, f"c {words}"), (3, "x"), (4, None)], "doc_id long, text string")
    spark.catalog.clearCache()
    before, frames = set(common.TABLES), len(spark.sparkContext._jsc.getPersistentRDDs())
    out = recompress.repeated_words(docs)
    assert set(common.TABLES) == before
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= frames + 1
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out.collect()} == {1: (42, 40, "a b"), 2: (41, 40, "c"), 3: (1, 0, "x"), 4: (0, 0, "")}
