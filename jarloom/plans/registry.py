"""The queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from ..operators import evaluate
from ..operators.similarity import exact_names, members, similarity, summaries, tie_flags, without_source
from ..sources import archives, lists
from ..sources.corpus import children, derived, file_records, lines_of, parse_records, sig_records, tallies, texts, with_tallies

D = r"""docs AS (SELECT doc_id, lang, source, text, sha1(text) AS h FROM documents WHERE text IS NOT NULL),
lines AS (SELECT DISTINCT h, line FROM (SELECT h, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE line <> ''),
files AS (SELECT DISTINCT source || '/' AS path, CASE WHEN doc_id % 7 = 0 THEN lang ELSE lang || '-' || CAST(doc_id AS VARCHAR) END AS basename, '.jar' AS suffix, -1 AS level, CAST(NULL AS VARCHAR) AS infilesha1, h AS filesha1 FROM docs
  UNION ALL SELECT DISTINCT 'c/', substr(line, 1, 12) || '-' || CAST(ascii(h) % 3 AS VARCHAR), CASE WHEN (length(line) + ascii(h)) % 2 = 0 THEN '.java' ELSE '.class' END, 0, h, sha1(line) FROM lines),
sigs AS (SELECT DISTINCT sha1(line) AS filesha1, substr(line, 1, 12) AS classname, sha1(array_to_string(string_split(line, ' ')[1:4], ' ')) AS sigsha1re,
  sha1(array_to_string(string_split(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ')[1:2], '')) AS losesigsha1re FROM lines)"""


def sim_sql(query: str | None, corpus: str | None, col: str = "sigsha1re", order: str = "jaccard_m DESC, inclusion_m DESC", versioned: bool = True, tally: str | None = None, tally_col: str | None = None, asked: str = "true", known: str = "true", given: str = "") -> str:
    """asked and known: conditions on the query's and the corpus's archives (a); given: the query's sets themselves."""
    side = lambda s, col=col: f"SELECT DISTINCT infilesha1 AS archive, s.{col} AS sig FROM files f JOIN sigs s ON f.filesha1 = s.filesha1 WHERE infilesha1 IS NOT NULL" + (f" AND suffix = '{s}'" if s else "")
    milli = lambda d: f"CASE WHEN {d} > 0 THEN CAST((2000 * i + {d}) // (2 * {d}) AS BIGINT) END"
    return f"""{D}, q AS ({given or f"SELECT * FROM ({side(query)}) a WHERE {asked}"}), c AS (SELECT * FROM ({side(corpus)}) a WHERE {known}), t AS (SELECT * FROM ({side(tally or corpus, tally_col or col)}) a WHERE {known}),
a AS (SELECT archive AS subject, count(*) AS a FROM q GROUP BY 1), b AS (SELECT archive, count(*) AS b FROM t GROUP BY 1),
i AS (SELECT q.archive AS subject, c.archive, count(*) AS i FROM q JOIN c USING (sig) GROUP BY 1, 2),
x AS (SELECT subject, a, b, i, a + b - i AS u, filesha1, artifact, path FROM i JOIN a USING (subject) JOIN b USING (archive)
  JOIN (SELECT DISTINCT filesha1, basename || suffix AS artifact, path FROM files WHERE infilesha1 IS NULL {"AND regexp_matches(basename, '[0-9]')" if versioned else ""}) n ON n.filesha1 = archive),
y AS (SELECT *, {milli("u")} AS jaccard_m, {milli("a")} AS inclusion_m, {milli("b")} AS enclosion_m FROM x),
results AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY {order}, artifact, filesha1, path) AS rank, a, b, i AS a_intersect_b, u AS a_union_b, jaccard_m, inclusion_m, enclosion_m,
  CAST(jaccard_m // 1000 AS VARCHAR) || '.' || lpad(CAST(jaccard_m % 1000 AS VARCHAR), 3, '0') AS jaccard, filesha1, artifact, path FROM y)"""


SIMS: dict[str, dict] = {
    "bin2bin_default": {"query": ".class", "corpus": ".class"},
    "bin2bin_by_inclusion": {"query": ".class", "corpus": ".class", "order": "inclusion"},
    "bin2bin_by_enclosion": {"query": ".class", "corpus": ".class", "order": "enclosion"},
    "src2src": {"query": ".java", "corpus": ".java"},
    "bin2src": {"query": ".class", "corpus": ".java"},
    "src2bin": {"query": ".java", "corpus": ".class"},
    "filehash_match": {"query": ".class", "corpus": ".class", "col": "filesha1"},
    "loose_match": {"query": ".class", "corpus": ".class", "col": "losesigsha1re"},
    "loose_match_tight_tally": {"query": ".class", "corpus": ".class", "col": "losesigsha1re", "tally_col": "sigsha1re"},
    "internal_match": {"query": None, "corpus": None, "tally": ".class"},
    "all_pairs_jaccard": {"query": None, "corpus": None, "versioned": False},
}
SQL_ORDERS = {"jaccard": "jaccard_m DESC, inclusion_m DESC", "inclusion": "inclusion_m DESC, jaccard_m DESC", "enclosion": "enclosion_m DESC, inclusion_m DESC, jaccard_m DESC"}
TRUTH_SQL = """near AS (SELECT h, max(mx) AS other FROM lines JOIN (SELECT line, max(h) AS mx FROM lines GROUP BY 1) USING (line) GROUP BY 1),
listed AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'jar-sha1' ELSE 'class-sha1' END AS type, h AS subject, CASE doc_id % 4 WHEN 0 THEN h WHEN 1 THEN other WHEN 2 THEN 'unknown' ELSE h END AS truth FROM docs LEFT JOIN near USING (h) WHERE doc_id % 9 <> 8),
truths AS (SELECT subject, max(truth) FILTER (type = 'jar-sha1') AS j, max(truth) FILTER (type = 'class-sha1') AS k FROM listed GROUP BY 1),
truth AS (SELECT d.h AS subject, coalesce(j, k) AS target, CASE WHEN j IS NOT NULL THEN 'JAR-SHA1-TRUTH' WHEN k IS NOT NULL THEN 'CLASS-SHA1-TRUTH' ELSE 'NEW-ANALYSIS' END AS truth_source FROM (SELECT DISTINCT h FROM docs) d LEFT JOIN truths ON subject = h)"""
SUBJECTS = "archive IN (SELECT h FROM docs WHERE doc_id % 10 = 0)"
NOT_IN = {"asked": "archive IN (SELECT h FROM docs WHERE doc_id % 4 = 0)", "known": "archive NOT IN (SELECT h FROM docs WHERE doc_id % 4 = 0)"}


def table(name: str):
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


def truth_list_lines(s, d) -> DataFrame:
    """A ground-truth list: for a subject itself, the greatest archive that has a line in common with it, an unknown one, or nothing."""
    docs = texts(s, d)
    lines = lines_of(docs).select(F.unhex("h").alias("k"), F.unhex(F.md5("line")).alias("line"))
    # the greatest is the archive itself unless a line has a greater one: few rows go on from here
    near = lines.withColumn("mx", F.max("k").over(W.partitionBy("line"))).filter("mx > k").groupBy("k").agg(F.max("mx").alias("mx"))
    kind = F.when(F.col("doc_id") % 2 == 0, "jar-sha1").otherwise("CLASS-SHA1")
    given = F.when(F.col("doc_id") % 4 == 1, F.col("other")).when(F.col("doc_id") % 4 == 2, F.lit("unknown")).when(F.col("doc_id") % 4 == 3, F.lit("")).otherwise(F.col("h"))
    x = docs.filter("doc_id % 9 <> 8").select("doc_id", "h", F.unhex("h").alias("k"), (F.translate("text", "\n", "") != "").alias("lined"))
    x = x.join(near, "k", "left").withColumn("other", F.when(F.col("lined"), F.coalesce(F.lower(F.hex("mx")), "h"))).select(F.concat(kind, F.lit(";x;"), "h", F.lit(";"), F.coalesce(given, F.lit(""))).alias("value"))
    return x.unionByName(s.createDataFrame([("# a list",), ("",)], "value string"))


def truth(s, d) -> DataFrame:
    subjects = derived(s, d)[0].filter("infilesha1 is null").select(F.col("filesha1").alias("subject")).distinct()
    return lists.truth_of(subjects, lists.ground_truth(truth_list_lines(s, d))).withColumnRenamed("truth", "target")


def subject_classes(s, d) -> DataFrame:
    subjects = derived(s, d)[0].filter("infilesha1 is null").select(F.col("filesha1").alias("subject"), F.concat("basename", "suffix").alias("name"))
    own = evaluate.families(subjects)
    x = summaries(*derived(s, d), kids=children(s, d), truth=truth(s, d).select("subject", "target").join(own, "subject"), **SIMS["bin2bin_default"])
    return evaluate.verdicts(own.select("subject").join(x, "subject", "left"))


def result_classes(s, d) -> DataFrame:
    known = truth(s, d).select("subject", "target", F.lit(None).cast("string").alias("family"))
    return evaluate.verdicts(summaries(*derived(s, d), kids=children(s, d), truth=known, **SIMS["bin2bin_default"]))


def some_docs(s, d, n: int, k: int = 0) -> DataFrame:
    return table("documents")(s, d).filter(f"text is not null and doc_id % {n} = {k}").select(F.sha1("text").alias("subject")).distinct()


def split_corpus(s, d):
    """A query set that is not in the corpus: every fourth document against the others."""
    files, sigs = derived(s, d)
    ids = some_docs(s, d, 4).withColumnRenamed("subject", "k")
    owner = F.coalesce("infilesha1", "filesha1")
    asked, rest = files.join(ids, owner == F.col("k"), "left_semi"), files.join(ids, owner == F.col("k"), "left_anti")
    return similarity(rest, sigs, ".class", ".class", asked=(asked, sigs))


def given_set(s, d):
    """Signatures that are given as they are: those of three documents together, without filters of suffix or digit."""
    files, sigs = derived(s, d)
    x = members(files, sigs, None).join(table("documents")(s, d).filter("doc_id < 3").select(F.sha1("text").alias("archive")), "archive", "left_semi")
    return similarity(files, sigs, None, None, versioned=False, given=x.select(F.lit("given").alias("subject"), "sig"))


def result_tree(s, d):
    subjects = truth(s, d).select("subject", "truth_source")
    return evaluate.placed(similarity(*derived(s, d), ".class", ".class", top=1, kids=children(s, d)), subject_classes(s, d), subjects).select("subject", "truth_source", "folder", "rank", "artifact")


def untallied(s, d) -> tuple[DataFrame, DataFrame]:
    """files with a tally of -1 already there for every archive whose name holds no digit."""
    files, sigs = derived(s, d)
    old = F.when(F.col("infilesha1").isNull() & ~F.col("basename").rlike("[0-9]"), F.lit(-1).cast("long"))
    return files.withColumns({"uniqjavasigre": old, "uniqclasssigre": old}), sigs


def tally_query(only_missing: bool):
    def run(s, d):
        files, sigs = untallied(s, d)
        return with_tallies(files.filter("infilesha1 is null"), tallies(files, sigs), only_missing).select("filesha1", "path", "basename", "uniqjavasigre", "uniqclasssigre")

    return run


def tally_sql(only_missing: bool) -> str:
    pick = (lambda c: f"coalesce(old, {c})") if only_missing else (lambda c: f"coalesce({c}, old)")
    return f"""WITH {D}, t AS (SELECT infilesha1, count(DISTINCT CASE WHEN suffix = '.java' THEN sigsha1re END) AS j, count(DISTINCT CASE WHEN suffix = '.class' THEN sigsha1re END) AS c FROM files f JOIN sigs s ON f.filesha1 = s.filesha1 WHERE infilesha1 IS NOT NULL GROUP BY 1),
f AS (SELECT *, CASE WHEN NOT regexp_matches(basename, '[0-9]') THEN CAST(-1 AS BIGINT) END AS old FROM files WHERE infilesha1 IS NULL)
SELECT f.filesha1, path, basename, {pick("j")} AS uniqjavasigre, {pick("c")} AS uniqclasssigre FROM f LEFT JOIN t ON t.infilesha1 = f.filesha1"""


def table_counts(s, d):
    files, sigs = derived(s, d)
    return files.agg(F.count("*").alias("n")).select(F.lit("files").alias("name"), "n").unionByName(sigs.agg(F.count("*").alias("n")).select(F.lit("sigs").alias("name"), "n"))


def fqns(s, d):
    """Lines as classes of a name (their first word): odd documents are what was found, even ones what is known."""
    x = table("documents")(s, d).filter("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    x = x.select(F.col("doc_id") % 2 == 1, F.substring_index("line", " ", 1), F.sha1("line")).toDF("odd", "fqn", "sighash").distinct()
    return x.filter("odd").drop("odd"), x.filter("not odd").drop("odd")


FQN_SQL = """x AS (SELECT DISTINCT doc_id % 2 = 1 AS odd, split_part(line, ' ', 1) AS fqn, sha1(line) AS sighash FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE line <> '')"""


def diff_query(s, d):
    x = table("documents")(s, d).filter("text is not null").select("doc_id", evaluate.signature_parts(F.col("text")).alias("lines"))
    pair = F.floor(F.col("doc_id") / 2).cast("long").alias("pair")
    return evaluate.positional_diff(x.filter("doc_id % 2 = 0").select(pair, "lines"), x.filter("doc_id % 2 = 1").select(pair, "lines"), "pair").select("pair", F.col("pos").cast("long").alias("pos"), "left_line", "right_line")


def containment(s, d):
    """Paths of none to three archives in one another, some found in a tar."""
    n, r, c = (table(t)(s, d) for t in ("nation", "region", "customer"))
    x = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey") % 4
    path = F.concat(F.when(k > 2, F.concat("r_name", F.lit("!/"))).otherwise(""), F.when(k > 1, F.concat("n_name", F.lit("!/"))).otherwise(""), F.when(k > 0, F.lit("a.jar!/")).otherwise(""), F.col("c_name"))
    tar = F.when(F.col("c_custkey") % 5 < 2, F.col("c_custkey") % 5)
    return x.select("c_custkey", "c_name", path.alias("path"), tar.alias("tar")).withColumns({"level": names.zip_level(F.col("path")).cast("long"), "in_tar": names.zip_level(F.col("path"), F.col("tar")).cast("long")}).drop("tar")


def doc_paths(s, d):
    """Paths with slashes and backslashes, suffixes of one and two dots, inner and anonymous classes."""
    name = F.concat(F.when(F.col("doc_id") % 6 == 5, "Doc").otherwise("Doc$"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 8 == 1, "$In.x").otherwise(""), F.element_at(F.array(*map(F.lit, (".class", ".TAR.gz", ".Jar", "", ".tar.bz2"))), (F.col("doc_id") % 5 + 1).cast("int")))
    return table("documents")(s, d).select("doc_id", "lang", "source", F.concat("source", F.lit("/"), "lang", F.when(F.col("doc_id") % 7 == 3, "\\").otherwise("/"), name).alias("p"))


PATHS_SQL = r"""x AS (SELECT doc_id, lang, source, source || '/' || lang || CASE WHEN doc_id % 7 = 3 THEN '\' ELSE '/' END || CASE WHEN doc_id % 6 = 5 THEN 'Doc' ELSE 'Doc$' END || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 8 = 1 THEN '$In.x' ELSE '' END || (['.class', '.TAR.gz', '.Jar', '', '.tar.bz2'])[doc_id % 5 + 1] AS p FROM documents)"""


def path_parts(s, d):
    x, p = doc_paths(s, d), F.col("p")
    return x.select("doc_id", names.relative_path(p).alias("dir"), names.base_name(F.lower(p)).alias("base"), names.suffix(F.lower(p)).alias("suffix"), names.fix_class_name(p).alias("fixed"), names.ultimate_parent(p).alias("parent"), names.immediate_parent(p).alias("direct"), names.is_inner_class(p).alias("inner"), names.is_anonymous_class(p).alias("anonymous"), names.family(F.concat(F.lit("a-b-"), p)).alias("family"))


PATH_SQL = rf"""WITH {PATHS_SQL},
y AS (SELECT *, regexp_extract(lower(p), '([^/\\]*)$', 1) AS n FROM x)
SELECT doc_id, regexp_extract(p, '^(.*/)', 1) AS dir, regexp_replace(n, '(\.tar\.[^.]*|\.[^.]*)$', '') AS base, regexp_extract(n, '(\.tar\.[^.]*|\.[^.]*)$', 1) AS suffix, translate(p, '/$', '..') AS fixed,
  CASE WHEN contains(p, '$') THEN split_part(p, '$', 1) || '.class' END AS parent, CASE WHEN contains(p, '$') THEN regexp_replace(p, '\$[^$]*$', '.class') END AS direct, ends_with(p, '.class') AND contains(p, '$') AS inner, regexp_matches(p, '\$[0-9]+\.class$') AS anonymous, regexp_replace(split_part('a-b-' || p, '.', 1), '-[^-]*$', '') AS family FROM y"""


def name_forms(s, d):
    """Types, names and versions made of part names, brands and types."""
    x = table("part")(s, d).select(F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_size")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("k") % len(v) + 1).cast("int"))
    x = x.withColumns({
        "t": pick("java.util.Map<java.lang.String,a.b.C>", "int", "a/b/C$D", "a.B<x.Y<z.W>>.C[]", "Plain<T>", "x.A<? extends y.B>"), "pkg": pick("", "org.x", "a"),
        "zip": F.concat(pick("lib", "my-lib-1.x", "b-2.0-rc", "no.dot-tail", "p-", "q-z"), pick(".jar", ".tar.gz", "", ".tar.bz2", ".zip", ".tgz", ".html")),
    }).withColumn("path", F.concat_ws("/", pick("usr", "3.1", " 4"), "p_brand", F.col("zip")))
    return x.select("k", names.fix_type_name(F.col("t")).alias("type"), names.strip_generic(F.col("t")).alias("plain"), names.fqn(F.col("pkg"), F.col("p_brand")).alias("fqn"), names.extract_version(F.col("zip"), F.col("path")).alias("version"), names.strip_path_and_suffix(F.col("path")).alias("stripped"), names.normalize_name(F.col("p_name")).alias("normal"), names.is_package_info(F.concat("path", F.when(F.col("k") % 3 == 0, "/package-Info.class").otherwise(""))).alias("info"))


FORMS_SQL = r"""WITH x AS (SELECT p_partkey AS k, p_name, p_brand, (['java.util.Map<java.lang.String,a.b.C>', 'int', 'a/b/C$D', 'a.B<x.Y<z.W>>.C[]', 'Plain<T>', 'x.A<? extends y.B>'])[p_partkey % 6 + 1] AS t, (['', 'org.x', 'a'])[p_partkey % 3 + 1] AS pkg,
  (['lib', 'my-lib-1.x', 'b-2.0-rc', 'no.dot-tail', 'p-', 'q-z'])[p_partkey % 6 + 1] || (['.jar', '.tar.gz', '', '.tar.bz2', '.zip', '.tgz', '.html'])[p_partkey % 7 + 1] AS zip FROM part),
y AS (SELECT *, (['usr', '3.1', ' 4'])[k % 3 + 1] || '/' || p_brand || '/' || zip AS path FROM x),
z AS (SELECT *, list_filter(string_split(path, '/'), lambda s: regexp_matches(trim(s), '^[0-9]'))[-1] AS own, string_split(zip, '-') AS parts,
  regexp_extract(zip, '-([^-]*)$', 1) AS tail, regexp_replace(zip, '-[^-]*$', '') AS head FROM y),
w AS (SELECT *, list_position(list_transform(parts, lambda s: regexp_matches(trim(s), '^[0-9]')), true) AS spot FROM z)
SELECT k, (['Map<String,C>', 'int', 'D', 'C[]', 'Plain<T>', 'A<? extends B>'])[k % 6 + 1] AS type, split_part(t, '<', 1) AS plain, CASE WHEN pkg = '' THEN p_brand ELSE pkg || '.' || p_brand END AS fqn,
  CASE WHEN own IS NOT NULL THEN trim(own) WHEN spot > 0 THEN '*' || regexp_replace(array_to_string(parts[spot:], '-'), '\.[^.]*$', '')
    WHEN tail <> '' AND (contains(tail, '.') OR NOT contains(head, '.')) THEN '**' || regexp_replace(tail, '\.[^.]*$', '') ELSE '' END AS version,
  regexp_replace(zip, '(\.tar\..{0,2}|\.(jar|zip|tgz|war|ear))$', '') AS stripped, regexp_replace(p_name, '[^\p{Nd}\p{L}.]', '', 'g') AS normal, k % 3 = 0 AS info FROM w"""


def nested_signatures(s, d):
    """Lines of documents as signatures: a class with members, two inner classes out of order, one of them with its own."""
    x = table("documents")(s, d).filter("text is not null").select(F.col("doc_id").alias("sig"), "lang", "source")
    n = F.col("sig").cast("string")
    line = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    rows = [line("c;0;public class p.", F.col("lang"), ".Z", n, " extends a.B"), line("f;0;  int ", F.col("source")), line("c;1;  class z.I", n), line("c;2;    class w.Q"), line("m;2;    void q()"), line("c;2;    class w.P"), line("m;1;  void z()"), line("c;1;  class ", F.when(F.col("sig") % 2 == 0, "a.A").otherwise("zz.A")), line("m;1;  void a()"), line("c;0;interface p.A", F.col("lang")), line("m;0;  int last()")]
    return x.select("sig", F.posexplode(F.array(*rows)).alias("pos", "value"))


NESTED_SQL = """n AS (SELECT doc_id AS sig, unnest(range(0, 11)) AS pos, unnest(['c;0;public class p.' || lang || '.Z' || CAST(doc_id AS VARCHAR) || ' extends a.B', 'f;0;  int ' || source, 'c;1;  class z.I' || CAST(doc_id AS VARCHAR), 'c;2;    class w.Q', 'm;2;    void q()', 'c;2;    class w.P', 'm;1;  void z()', 'c;1;  class ' || CASE WHEN doc_id % 2 = 0 THEN 'a.A' ELSE 'zz.A' END, 'm;1;  void a()', 'c;0;interface p.A' || lang, 'm;0;  int last()']) AS value FROM documents WHERE text IS NOT NULL)"""


def old_packs(s, d):
    """Customers as packs of nested containers with classes in them, as the older output has it."""
    x = table("customer")(s, d).select(F.col("c_custkey").alias("stream"), (F.col("c_custkey") % 5).alias("m"))
    k = F.col("stream").cast("string")
    line = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    sig = [line("n;a", k, ".class"), line("c;0;class a", k), line("m;0;  int b()")]
    rows = [line(">>>>>>>;Starting"), line("P;0;top", k, ".jar;top;./;.jar;pack", k), line("P;1;in.jar;in;./;.jar;top", k), line("P;2;a", k, ".class;a;./;.class;in"), *sig, line(""), line("P;2;b.class;b;./;.class;", F.when(F.col("m") == 0, "in").otherwise("other")), *sig, line("n;b.class"), line("c;0;class b"), line("P;1;c.class;c;./;.class;again"), *sig]
    return x.select("stream", F.posexplode(F.array(*rows)).alias("pos", "value"))


STACK_SQL = """WITH x AS (SELECT c_custkey AS stream, CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 5 = 0 THEN 'in' ELSE 'other' END AS o FROM customer),
y AS (SELECT *, 'a' || k || '.class;' || sha1('c;0;class a' || k || chr(10) || 'm;0;  int b()') AS s FROM x)
SELECT stream, unnest([1, 2, 3, 5, 8, 10, 13, 14, 16]) AS pos, unnest(['P;top' || k || '.jar;;0;pack' || k, 'P;in.jar;;1;pack' || k || ';top' || k, 'P;a' || k || '.class;;2;pack' || k || ';top' || k || ';in',
  'SHA1;' || s || ';a' || k || '.class;2;pack' || k || ';top' || k || ';in', 'P;b.class;;2;pack' || k || ';top' || k || ';' || o, 'SHA1;' || s || ';b.class;2;pack' || k || ';top' || k || ';' || o,
  'SHA1;b.class;' || sha1('c;0;class b') || ';b.class;2;pack' || k || ';top' || k || ';' || o, 'P;c.class;;1;pack' || k || ';top' || k, 'SHA1;' || s || ';c.class;1;pack' || k || ';top' || k]) AS record FROM y"""


def sig_packs(s, d):
    """Suppliers as packs with signatures, and the files' hashes before them; a name comes twice with another hash."""
    x = table("supplier")(s, d).select(F.col("s_suppkey").alias("stream"))
    k = F.col("stream").cast("string")
    line = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    rows = [line("Z;0;p.zip;z"), line("P;0;A.class;A;./;.class;s;h1-", k), line("S;x"), line("n;A.class;org.A", k), line("c;0;public class org.x.A", k, " extends b.C"), line("f;0;  int a"), line(""), line("P;0;A.class;A;./;.class;s;h2-", k), line("n;A.class;org.A"), line("c;0;class q.A"), line("c;1;  class org.q.A.B"), line("E;none")]
    return x.select("stream", F.posexplode(F.array(*rows)).alias("pos", "value"))


SIG_PACK_SQL = """WITH x AS (SELECT s_suppkey AS stream, CAST(s_suppkey AS VARCHAR) AS k FROM supplier)
SELECT stream, 4 AS pos, 'h1-' || k AS filesha1, 'org.A' || k AS classname, 'c;0;public class org.x.A' || k || ' extends b.C' || chr(10) || 'f;0;  int a' || chr(10) AS signature, 'c;0;public class A' || k || ' extends b.C' || chr(10) || 'f;0;  int a' || chr(10) AS loose FROM x
UNION ALL SELECT stream, 9, 'h2-' || k, 'org.A', 'c;0;class q.A' || chr(10) || 'c;1;  class org.q.A.B' || chr(10), 'c;0;class A' || chr(10) || 'c;1;  class B' || chr(10) FROM x"""


def debian_lookup(s, d):
    """Part names looked up in an index made of them, some with variants that don't count."""
    x = table("part")(s, d).select(F.col("p_partkey").alias("k"))
    n = F.concat(F.lit("p"), F.col("k").cast("string"), F.lit("x"))
    f = lambda *c: F.concat(F.lit("Filename: pool/main/"), *(F.lit(x) if isinstance(x, str) else x for x in c))
    rows = F.array(f(n, "/", n, "_1.deb"), F.when(F.col("k") % 3 == 0, f("o/", n, "_2.deb")), F.when(F.col("k") % 4 == 0, f(n, "/", n, "_3.deb")), f(n, "/", n, "-dev_1.deb"), f("lib", n, "/lib", n, "_1.deb"))
    index = x.select(F.explode(F.filter(rows, lambda v: v.isNotNull())).alias("value"))
    return lists.debian_index(x.select(F.when(F.col("k") % 10 == 0, F.concat(F.lit("none"), n)).otherwise(n).alias("name")), index.unionByName(x.select(F.concat(F.lit("Size: "), F.col("k").cast("string")).alias("value"))), "m/")


def report(s, d):
    """Lines as classes with their words as signature lines."""
    x = table("documents")(s, d).filter("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    x = x.select((F.col("doc_id") % 2 == 1).alias("odd"), F.substring_index("line", " ", 1).alias("fqn"), F.sha1(F.substring_index("line", " ", 3)).alias("sighash"), F.translate(F.substring_index("line", " ", 3), " ", "|").alias("signature"))
    return evaluate.mismatch_report(x.filter("odd and doc_id % 7 = 1").drop("odd"), x.filter("not odd and doc_id % 8 = 2").drop("odd"))


REPORT_SQL = """WITH x AS (SELECT DISTINCT doc_id % 7 = 1 AND doc_id % 2 = 1 AS f, doc_id % 8 = 2 AS k, split_part(line, ' ', 1) AS fqn, array_to_string(string_split(line, ' ')[1:3], ' ') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE line <> ''),
a AS (SELECT DISTINCT fqn, t FROM x WHERE f), b AS (SELECT DISTINCT fqn, t FROM x WHERE k), r AS (SELECT * FROM a WHERE (fqn, t) NOT IN (SELECT (fqn, t) FROM b)),
p AS (SELECT r.fqn, r.t, b.t AS u, b.fqn IS NOT NULL AS has FROM r LEFT JOIN b ON b.fqn = r.fqn),
e AS (SELECT *, unnest(CASE WHEN has THEN range(0, greatest(len(string_split_regex(t, '[ |]')), len(string_split_regex(u, '[ |]')))) ELSE [NULL] END) AS pos FROM p),
g AS (SELECT *, string_split_regex(t, '[ |]')[pos + 1] AS found_line, string_split_regex(u, '[ |]')[pos + 1] AS known_line FROM e)
SELECT fqn, sha1(t) AS sighash, CASE WHEN has THEN 'MISMATCH' ELSE 'NO-FQN' END AS verdict, sha1(u) AS known_hash, pos, CASE WHEN has THEN found_line END AS found_line, known_line FROM g WHERE NOT has OR found_line IS DISTINCT FROM known_line"""


def signature_lines(s, d):
    x = table("documents")(s, d).filter("text is not null").select("doc_id", F.filter(F.split("text", "\n"), lambda v: v != "").alias("v"))
    key = F.transform(F.array_sort(F.transform("v", lambda v: F.struct(F.translate(v, *names.LOWER).alias("k"), v.alias("v")))), lambda r: r["v"])
    x = x.select("doc_id", F.array_join(key, "\n").alias("sig"))
    return x.select("doc_id", names.tight_hash(F.col("sig")).alias("tight"))


def fold_names(s, d):
    files, _ = derived(s, d)
    return files.filter("infilesha1 is null").groupBy("path").agg(F.when(F.countDistinct("basename") == 1, F.min("basename")).otherwise("[various...]").alias("subject"), F.count("*").alias("n"))


def list_lines(s, d):
    """Lines of documents as lines of a known-hash list, some of them comments or errors."""
    x = table("documents")(s, d).filter("text is not null").select("doc_id", "lang", "source", F.sha1("text").alias("h"))
    tag = F.element_at(F.array(*map(F.lit, ("E", "n", "N", "org", "com"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return x.select(F.concat_ws(";", F.concat_ws(".", tag, "lang", "source"), "h", F.concat("source", F.lit("/"), "lang")).alias("value"), "doc_id")


def known_list(s, d):
    x = list_lines(s, d).select(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("E;"), "value")).when(F.col("doc_id") % 10 == 3, F.lit("  ")).otherwise(F.col("value")).alias("value"))
    return lists.known_hashes(x)


def truth_list(s, d):
    x = table("documents")(s, d).filter("text is not null")
    kind = F.element_at(F.array(*map(F.lit, ("JAR-sha1", "class-sha1", "# jar-sha1", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(";"), F.upper("lang"), F.lit(" "))).when(F.col("doc_id") % 3 == 1, F.lit("; ")).otherwise("")
    return lists.ground_truth(x.select(F.concat(kind, F.lit(";x;"), F.upper(F.sha1("text")), given).alias("value")))


def order_lines(s, d):
    """Orders as packs of the older stream: each customer's orders in turn, a container, files with levels, and F records."""
    o = table("orders")(s, d).select("o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey").cast("string")
    z = F.concat(F.lit("Z;0;/packs/p"), k, F.lit(".zip;z"), k)
    p = F.concat(F.lit("P;"), (F.col("o_orderkey") % 3).cast("string"), F.lit(";f"), k, F.lit(".x;f"), k, F.lit(";./;"), F.when(F.col("o_orderkey") % 2 == 0, ".class").otherwise(".jar"), F.lit(";/s;h"), k)
    f = F.concat(F.lit("F;a/;f"), k, F.lit(";.class;?;?;s"), k, F.lit(";NULL"))
    x = o.select(F.col("o_custkey").alias("stream"), "o_orderkey", F.posexplode(F.array(z, F.lit("A;x"), p, f, F.lit("T;1"))).alias("n", "value"))
    return x.select("stream", (F.col("o_orderkey") * 10 + F.col("n")).cast("long").alias("pos"), "value")


PACK_SQL = r"""WITH o AS (SELECT o_custkey AS stream, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS top FROM orders)
SELECT stream, CAST(k * 10 AS BIGINT) AS pos, 'F;/packs/;p' || k || ';.zip;-1;NULL;z' || k || ';NULL;NULL;NULL;NULL' AS record FROM o WHERE top
UNION ALL SELECT stream, CAST(k * 10 + 2 AS BIGINT), 'F;./;f' || k || ';.jar;' || (k % 3) || ';z' || k || ';h' || k || ';NULL;NULL;NULL;NULL' FROM o WHERE k % 2 <> 0
UNION ALL SELECT stream, CAST(k * 10 + 3 AS BIGINT), 'F;a/;f' || k || ';.class;' || (k % 3) || ';z' || k || ';s' || k || ';NULL' FROM o"""


def tree(s, d):
    """Region, nation, customer and order as containers in one another."""
    n, c, o = (table(t)(s, d) for t in ("nation", "customer", "orders"))
    key = lambda a, b: F.concat(F.lit(a), F.col(b).cast("string"))
    x = n.select(key("n", "n_nationkey").alias("filesha1"), key("r", "n_regionkey").alias("infilesha1"))
    x = x.unionByName(c.select(key("c", "c_custkey").alias("filesha1"), key("n", "c_nationkey").alias("infilesha1")))
    x = x.unionByName(o.select(key("o", "o_orderkey").alias("filesha1"), key("c", "o_custkey").alias("infilesha1")))
    return lists.ancestors(x).select("filesha1", "container", F.col("distance").cast("long").alias("distance"))


TREE_SQL = """WITH RECURSIVE t AS (SELECT 'n' || n_nationkey AS f, 'r' || n_regionkey AS a FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
u AS (SELECT f AS filesha1, a AS container, CAST(1 AS BIGINT) AS distance FROM t UNION ALL SELECT u.filesha1, t.a, u.distance + 1 FROM u JOIN t ON t.f = u.container) SELECT * FROM u"""


def debian_paths(s, d):
    x = table("part")(s, d).select(F.col("p_partkey").alias("k"))
    n = lambda e: F.element_at(F.array(*map(F.lit, e)), (F.col("k") % len(e) + 1).cast("int"))
    v = F.concat((F.col("k") % 4).cast("string"), F.lit("."), (F.col("k") % 3).cast("string"))
    w = F.concat((F.col("k") % 4).cast("string"), F.lit("."), (F.col("k") % 6).cast("string"))
    return lists.debian_matches(x.select(F.concat(F.lit("pool/lib"), F.col("k").cast("string"), F.lit("_"), v, n(("-1", "+dfsg-2", ".dfsg-1", "")), F.lit("_all"), n((".deb/", ".rpm/", ".deb/")), n(("data.tar.gz/", "data.tar.xz/", "control/", "data.tar.bz2/", "data.tar.gz/")), F.lit("usr/share/java/lib-"), w, F.lit(".jar")).alias("value")))


DEBIAN_SQL = """WITH x AS (SELECT p_partkey AS k, (p_partkey % 4) || '.' || (p_partkey % 3) AS v, (p_partkey % 4) || '.' || (p_partkey % 6) AS w FROM part),
y AS (SELECT *, 'pool/lib' || k || '_' || v || (['-1', '+dfsg-2', '.dfsg-1', ''])[k % 4 + 1] || '_all' || (['.deb/', '.rpm/', '.deb/'])[k % 3 + 1] || (['data.tar.gz/', 'data.tar.xz/', 'control/', 'data.tar.bz2/', 'data.tar.gz/'])[k % 5 + 1] || 'usr/share/java/lib-' || w || '.jar' AS value FROM x)
SELECT value, 'lib-' || w || '.jar' AS jar, v || '.jar' AS version FROM y WHERE k % 3 <> 1 AND k % 5 <> 2 AND k % 4 <> 3 AND contains('lib-' || w || '.jar', v || '.jar')"""


def queries() -> dict:
    out = {k: (lambda s, d, v=v: similarity(*derived(s, d), kids=children(s, d), **v)) for k, v in SIMS.items()}
    out |= {
        "exact_hash_lookup": lambda s, d: exact_names(derived(s, d)[0]),
        "binary_without_source": lambda s, d: without_source(*derived(s, d)),
        "tallies_update_all": tally_query(False),
        "tallies_update_null_only": tally_query(True),
        "table_counts": table_counts,
        "distinct_corpus": lambda s, d: members(*derived(s, d), None).groupBy("archive").agg(F.count("*").alias("n")),
        "known_hash_antijoin": lambda s, d: evaluate.known_hash_report(*fqns(s, d)),
        "known_hash_mismatch_diff": diff_query,
        "containment_parent": containment,
        "classify_results": result_classes,
        "classify_subjects": subject_classes,
        "evaluation_matrix": lambda s, d: evaluate.matrix(subject_classes(s, d)),
        "evaluation_totals": lambda s, d: evaluate.totals(subject_classes(s, d)),
        "match_bits": lambda s, d: evaluate.match_bits(subject_classes(s, d)).select("subject", "bits", "folder"),
        "folder_names": lambda s, d: s.range(-1, 17).select("id", evaluate.folder(F.col("id")).alias("folder")),
        "result_tree": result_tree,
        "truth_lookup": truth,
        "bin2bin_subject": lambda s, d: similarity(*derived(s, d), kids=children(s, d), **SIMS["bin2bin_default"], subjects=some_docs(s, d, 10)),
        "bin2bin_top3": lambda s, d: similarity(*derived(s, d), kids=children(s, d), **SIMS["bin2bin_default"], top=3),
        "bin2bin_outside_query": split_corpus,
        "given_signatures": given_set,
        "jar_hash_lookup": lambda s, d: exact_names(derived(s, d)[0], some_docs(s, d, 10).withColumnRenamed("subject", "filesha1")),
        "matched_hash_count": lambda s, d: evaluate.matched_hashes(*fqns(s, d)),
        "mismatch_report": report,
        "name_forms": name_forms,
        "inner_class_listing": lambda s, d: doc_paths(s, d).filter(names.is_inner_class(F.col("p"))).select(F.concat(names.ultimate_parent(F.col("p")), F.lit("]\t["), names.immediate_parent(F.col("p")), F.lit("]\t["), "p", F.lit("]")).alias("line")),
        "known_suffix_paths": lambda s, d: lists.known_suffix(doc_paths(s, d).select("doc_id", F.col("p").alias("value"))),
        "unpack_log_lines": lambda s, d: lists.unpack_log(doc_paths(s, d).select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "BeginUnpack;").otherwise("EndUnpack;"), "p").alias("value")), ".class"),
        "target_prefix": lambda s, d: archives.below(doc_paths(s, d).select("doc_id", F.col("p").alias("fullpath")), "src1/en"),
        "class_lines": lambda s, d: lists.signature_lines(order_lines(s, d).unionByName(nested_signatures(s, d).select(F.col("sig").alias("stream"), F.col("pos").cast("long").alias("pos"), "value"))),
        "record_counts": lambda s, d: lists.record_counts(order_lines(s, d)),
        "class_reorder": lambda s, d: lists.reorder_classes(nested_signatures(s, d)),
        "old_loose_rule": lambda s, d: nested_signatures(s, d).select("sig", F.col("pos").cast("long").alias("pos"), names.old_loose_line(F.col("value")).alias("value")),
        "signature_hashes": lambda s, d: nested_signatures(s, d).filter("pos in (0, 9)").select("sig", F.col("pos").cast("long").alias("pos"), F.concat(F.when(F.col("sig") % 11 == 0, "e;x\n").otherwise(""), F.col("value"), F.lit("\nm;0;  p.Q r()\t \n")).alias("t")).select("sig", "pos", names.tight_hash(F.col("t")).alias("tight"), names.loose_hash(F.col("t")).alias("loose")),
        "pack_signatures": lambda s, d: lists.pack_signatures(sig_packs(s, d)).withColumn("pos", F.col("pos").cast("int")),
        "container_stack": lambda s, d: lists.container_records(old_packs(s, d)).withColumn("pos", F.col("pos").cast("int")),
        "shuffled_lines": lambda s, d: lists.shuffled(doc_paths(s, d).select("doc_id", F.col("p").alias("value")), 7),
        "sorted_paths": lambda s, d: doc_paths(s, d).select("source", "p", F.row_number().over(W.partitionBy("source").orderBy("p", "doc_id")).cast("long").alias("place")),
        "class_order": lambda s, d: archives.in_class_order(doc_paths(s, d).select("doc_id", F.col("source").alias("package"), F.col("lang").alias("classname"), F.col("p").alias("fullpath"))),
        "signature_text": lambda s, d: archives.signature_text(nested_signatures(s, d).filter("pos = 0").select(F.col("sig").cast("string").alias("fullpath"), F.concat("value", F.lit("\nf;0;  x.Y z")).alias("signature")), loose=True),
        "error_records": lambda s, d: archives.error_records(table("part")(s, d).select(F.lit("a/").alias("path"), F.col("p_brand").alias("basename"), F.lit(".class").alias("suffix"), F.when(F.col("p_size") > 25, F.concat("p_type", F.lit("\n"), "p_name")).alias("error"))),
        "query_list": lambda s, d: lists.query_list(doc_paths(s, d).select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(";"), "p")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), "p", F.lit(" "))).otherwise(" ").alias("value"))),
        "sha1_listing": lambda s, d: lists.sha1_listing(table("documents")(s, d).select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))),
        "debian_lookup": debian_lookup,
        "tie_flags": lambda s, d: tie_flags(*derived(s, d), kids=children(s, d), **SIMS["bin2bin_default"]),
        "subject_name_fold": fold_names,
        "wire_format_files": lambda s, d: file_records(derived(s, d)[0].filter("infilesha1 is null")),
        "wire_format_sigs": lambda s, d: sig_records(derived(s, d)[1]),
        "wire_parse_roundtrip": lambda s, d: parse_records(file_records(derived(s, d)[0].filter("infilesha1 is null").withColumn("uniqclasssigre", F.length("path"))))[0],
        "path_parts": path_parts,
        "sorted_signature_lines": signature_lines,
        "known_hash_list": known_list,
        "ground_truth_list": truth_list,
        "pack_records": lambda s, d: lists.pack_records(order_lines(s, d)),
        "containment_ancestors": tree,
        "debian_version_filter": debian_paths,
    }
    return out


def oracle_sql() -> dict[str, str]:
    sql = {k: "WITH " + sim_sql(**v | {"order": SQL_ORDERS[v.get("order", "jaccard")]}) + " SELECT * FROM results" for k, v in SIMS.items()}
    base = "WITH " + sim_sql(".class", ".class")
    cls = f"""{base}, {TRUTH_SQL}, s AS (SELECT filesha1 AS subject, regexp_replace(split_part(lower(min(basename || suffix)), '.', 1), '-[^-]*$', '') AS family FROM files WHERE infilesha1 IS NULL GROUP BY 1),
best AS (SELECT r.*, t.target, s.family, max(jaccard_m) OVER w AS top_j, max(a_intersect_b) OVER w AS top_i, first_value(a_intersect_b) OVER (PARTITION BY r.subject ORDER BY rank) AS lead FROM results r LEFT JOIN truth t ON t.subject = r.subject JOIN s ON s.subject = r.subject WINDOW w AS (PARTITION BY r.subject)),
run AS (SELECT *, min(rank) FILTER (a_intersect_b <> lead) OVER (PARTITION BY subject) AS behind FROM best),
g AS (SELECT subject, max(top_j) AS best, count(*) FILTER (jaccard_m = top_j) AS ties, count(*) FILTER (behind IS NULL OR rank < behind) AS top_count, min(rank) FILTER (filesha1 = target) AS hit_rank, max(jaccard_m) FILTER (filesha1 = target) AS hit_j,
  min(rank) FILTER (filesha1 IS DISTINCT FROM target AND a_intersect_b = top_i AND contains(lower(artifact), family)) AS related_rank FROM run GROUP BY 1),
verdicts AS (SELECT s.subject, ties, top_count, hit_rank, related_rank, CASE WHEN best = 1000 THEN '1.000' WHEN best IS NOT NULL THEN '0.999' END AS band, CASE WHEN ties > 1 THEN 'MULTI' WHEN best IS NOT NULL THEN 'SINGLE' END AS multiplicity,
  CASE WHEN best IS NULL THEN 'NO_MATCH' WHEN hit_j = best THEN 'PERFECT' WHEN hit_rank IS NOT NULL OR related_rank IS NOT NULL THEN 'CORRECT' ELSE 'WRONG' END AS verdict FROM s LEFT JOIN g ON g.subject = s.subject),
bits AS (SELECT *, CASE WHEN verdict <> 'NO_MATCH' THEN (CASE WHEN band = '1.000' THEN 1 ELSE 0 END) + (CASE WHEN multiplicity = 'SINGLE' THEN 2 ELSE 0 END) + (CASE verdict WHEN 'PERFECT' THEN 4 WHEN 'CORRECT' THEN 8 ELSE 0 END) END AS bits,
  CASE WHEN verdict = 'NO_MATCH' THEN verdict ELSE multiplicity || '/' || verdict || '/' || band END AS folder FROM verdicts)"""
    some = lambda **k: "WITH " + sim_sql(**SIMS["bin2bin_default"], **k)
    given = "SELECT DISTINCT 'given' AS archive, sigsha1re AS sig FROM files f JOIN sigs s ON f.filesha1 = s.filesha1 WHERE infilesha1 IN (SELECT h FROM docs WHERE doc_id < 3)"
    kinds = "jar|zip|war|ear|tar|tgz|tar.gz|tar.bz2|tar.xz|tar.lzma|deb|class|java"
    rec = "concat_ws(';', 'F', path, basename, suffix, CAST(level AS VARCHAR), coalesce(infilesha1, '\\N'), filesha1, '\\N', '\\N', '\\N', '\\N')"
    return sql | {
        "exact_hash_lookup": f"WITH {D} SELECT filesha1, basename || suffix AS artifact, count(DISTINCT path) AS places FROM files WHERE infilesha1 IS NULL GROUP BY 1, 2",
        "jar_hash_lookup": f"WITH {D} SELECT filesha1, basename || suffix AS artifact, count(DISTINCT path) AS places FROM files WHERE infilesha1 IS NULL AND filesha1 IN (SELECT h FROM docs WHERE doc_id % 10 = 0) GROUP BY 1, 2",
        "binary_without_source": f"WITH {D}, x AS (SELECT f.*, s.sigsha1re FROM files f JOIN sigs s ON f.filesha1 = s.filesha1 WHERE infilesha1 IS NOT NULL), o AS (SELECT sigsha1re FROM x WHERE suffix <> '.java' EXCEPT SELECT sigsha1re FROM x WHERE suffix = '.java') SELECT DISTINCT x.basename || x.suffix AS filename, p.basename || p.suffix AS container, sigsha1re FROM x JOIN files p ON p.filesha1 = x.infilesha1 AND p.infilesha1 IS NULL WHERE x.suffix <> '.java' AND sigsha1re IN (SELECT sigsha1re FROM o)",
        "tallies_update_all": tally_sql(False),
        "tallies_update_null_only": tally_sql(True),
        "table_counts": f"WITH {D} SELECT 'files' AS name, count(*) AS n FROM files UNION ALL SELECT 'sigs', count(*) FROM sigs",
        "distinct_corpus": f"WITH {D} SELECT infilesha1 AS archive, count(DISTINCT sigsha1re) AS n FROM files f JOIN sigs s ON f.filesha1 = s.filesha1 WHERE infilesha1 IS NOT NULL GROUP BY 1",
        "known_hash_antijoin": f"WITH {FQN_SQL} SELECT DISTINCT fqn, sighash, CASE WHEN fqn IN (SELECT fqn FROM x WHERE NOT odd) THEN 'MISMATCH' ELSE 'NO-FQN' END AS verdict FROM x WHERE odd AND (fqn, sighash) NOT IN (SELECT (fqn, sighash) FROM x WHERE NOT odd)",
        "known_hash_mismatch_diff": "WITH x AS (SELECT doc_id, doc_id // 2 AS pair, string_split_regex(text, '[\n|]') AS v FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id % 2 AS side, pair, unnest(v) AS line, unnest(range(0, len(v))) AS pos FROM x), l AS (SELECT * FROM e WHERE side = 0), r AS (SELECT * FROM e WHERE side = 1) SELECT coalesce(l.pair, r.pair) AS pair, coalesce(l.pos, r.pos) AS pos, l.line AS left_line, r.line AS right_line FROM l FULL JOIN r ON l.pair = r.pair AND l.pos = r.pos WHERE l.line IS DISTINCT FROM r.line",
        "containment_parent": """SELECT c_custkey, c_name, CASE WHEN k > 2 THEN r_name || '!/' ELSE '' END || CASE WHEN k > 1 THEN n_name || '!/' ELSE '' END || CASE WHEN k > 0 THEN 'a.jar!/' ELSE '' END || c_name AS path, k - 1 AS level, CASE WHEN t < 2 THEN t + k + 1 ELSE k - 1 END AS in_tar
  FROM (SELECT *, c_custkey % 4 AS k, c_custkey % 5 AS t FROM customer) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
        "classify_results": cls + " SELECT v.* REPLACE (CASE WHEN verdict = 'CORRECT' AND hit_rank IS NULL THEN 'WRONG' ELSE verdict END AS verdict, NULL::BIGINT AS related_rank) FROM verdicts v WHERE verdict <> 'NO_MATCH'",
        "classify_subjects": cls + " SELECT * FROM verdicts",
        "evaluation_matrix": cls + " SELECT band, multiplicity, count(*) FILTER (verdict = 'PERFECT') AS perfect, count(*) FILTER (verdict = 'CORRECT') AS correct, count(*) FILTER (verdict = 'WRONG') AS wrong, count(*) FILTER (verdict = 'NO_MATCH') AS no_match FROM verdicts GROUP BY 1, 2",
        "evaluation_totals": cls + " SELECT band, multiplicity, verdict, count(*) AS n FROM verdicts GROUP BY 1, 2, 3 UNION ALL SELECT NULL, NULL, 'TOTAL', count(*) FROM verdicts",
        "match_bits": cls + " SELECT subject, bits, folder FROM bits",
        "folder_names": """SELECT i AS id, CASE WHEN i BETWEEN 0 AND 15 AND i & 12 <> 12 THEN CASE WHEN i & 2 = 2 THEN 'SINGLE' ELSE 'MULTI' END || '/' || CASE WHEN i & 4 = 4 THEN 'PERFECT' WHEN i & 8 = 8 THEN 'CORRECT' ELSE 'WRONG' END || '/' || CASE WHEN i & 1 = 1 THEN '1.000' ELSE '0.999' END ELSE 'UNKNOWN' END AS folder FROM range(-1, 17) t(i)""",
        "result_tree": cls + " SELECT b.subject, truth_source, replace(folder, '/', '-') AS folder, r.rank, artifact FROM bits b LEFT JOIN truth t ON t.subject = b.subject LEFT JOIN (SELECT * FROM results WHERE rank = 1) r ON r.subject = b.subject",
        "truth_lookup": f"WITH {D}, {TRUTH_SQL} SELECT * FROM truth",
        "bin2bin_subject": some(asked=SUBJECTS) + " SELECT * FROM results",
        "bin2bin_top3": some() + " SELECT * FROM results WHERE rank <= 3",
        "bin2bin_outside_query": some(**NOT_IN) + " SELECT * FROM results",
        "given_signatures": "WITH " + sim_sql(None, None, versioned=False, given=given) + " SELECT * FROM results",
        "matched_hash_count": f"WITH {FQN_SQL} SELECT count(DISTINCT sighash) AS n FROM x WHERE odd AND sighash IN (SELECT sighash FROM x WHERE NOT odd)",
        "mismatch_report": REPORT_SQL,
        "name_forms": FORMS_SQL,
        "inner_class_listing": rf"WITH {PATHS_SQL} SELECT split_part(p, '$', 1) || '.class]' || chr(9) || '[' || regexp_replace(p, '\$[^$]*$', '.class') || ']' || chr(9) || '[' || p || ']' AS line FROM x WHERE ends_with(p, '.class') AND contains(p, '$')",
        "known_suffix_paths": rf"WITH {PATHS_SQL} SELECT doc_id, p AS value FROM x WHERE regexp_matches(lower(p), '\.({kinds})$')",
        "unpack_log_lines": rf"WITH {PATHS_SQL} SELECT doc_id, 'BeginUnpack;' || p AS value FROM x WHERE doc_id % 2 = 0 AND contains(p, '.class')",
        "target_prefix": rf"WITH {PATHS_SQL} SELECT doc_id, p AS fullpath FROM x WHERE starts_with(p, 'src1/en')",
        "class_lines": f"WITH {NESTED_SQL} SELECT sig AS stream, pos, value FROM n",
        "record_counts": "SELECT t AS tag, count(*) AS n FROM orders, (SELECT unnest(['Z', 'A', 'P', 'F', 'T']) AS t) GROUP BY 1",
        "class_reorder": f"""WITH {NESTED_SQL} SELECT sig, CAST(list_position(CASE WHEN sig % 2 = 0 THEN [9, 10, 0, 1, 7, 8, 2, 6, 5, 3, 4] ELSE [9, 10, 0, 1, 2, 6, 5, 3, 4, 7, 8] END, pos) AS BIGINT) AS place, value FROM n""",
        "old_loose_rule": rf"WITH {NESTED_SQL} SELECT sig, pos, CASE WHEN starts_with(value, 'c;') THEN regexp_replace(value, '([^. ]+\.)+', '') ELSE value END AS value FROM n",
        "signature_hashes": rf"""WITH {NESTED_SQL}, t AS (SELECT sig, pos, CASE WHEN sig % 11 = 0 THEN 'e;x' || chr(10) ELSE '' END || value || chr(10) || 'm;0;  p.Q r()' AS t FROM n WHERE pos IN (0, 9))
  SELECT sig, pos, sha1(t || chr(10)) AS tight, sha1(CASE WHEN sig % 11 = 0 THEN t ELSE regexp_replace(t, '(class|interface) ([^ .]*\.)+', '\1 ') END || chr(10)) AS loose FROM t""",
        "pack_signatures": SIG_PACK_SQL,
        "container_stack": STACK_SQL,
        "shuffled_lines": rf"WITH {PATHS_SQL} SELECT doc_id, p AS value, md5('7:' || p) AS key FROM x",
        "sorted_paths": rf"WITH {PATHS_SQL} SELECT source, p, row_number() OVER (PARTITION BY source ORDER BY p, doc_id) AS place FROM x",
        "class_order": rf"WITH {PATHS_SQL} SELECT doc_id, source AS package, lang AS classname, p AS fullpath FROM x",
        "signature_text": rf"WITH {NESTED_SQL} SELECT CAST(sig AS VARCHAR) AS fullpath, chr(10) || 'n;' || CAST(sig AS VARCHAR) || chr(10) || regexp_replace(value, 'class ([^ .]*\.)+', 'class ') || chr(10) || 'f;0;  x.Y z' AS text FROM n WHERE pos = 0",
        "error_records": "SELECT 'E;a/' || p_brand || '.class;' || p_type || ' ' || p_name AS record FROM part WHERE p_size > 25",
        "query_list": rf"WITH {PATHS_SQL} SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id END AS line_no, p AS path FROM x WHERE doc_id % 3 < 2",
        "sha1_listing": "SELECT 'SHA1;' || CAST(doc_id AS VARCHAR) || CASE WHEN text IS NULL THEN ';-1;' ELSE ';0;' || sha1(text) END AS record FROM documents",
        "debian_lookup": """SELECT CASE WHEN p_partkey % 10 = 0 THEN 'nonep' ELSE 'p' END || p_partkey || 'x' AS name, CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 4 <> 0 THEN 'm/pool/main/p' || p_partkey || 'x/p' || p_partkey || 'x_1.deb' END AS url FROM part""",
        "tie_flags": base + ", z AS (SELECT *, first_value(a_intersect_b) OVER w AS fi, coalesce(lag(jaccard_m) OVER w = jaccard_m, false) OR coalesce(lead(jaccard_m) OVER w = jaccard_m, false) AS neighbour_tie FROM results WINDOW w AS (PARTITION BY subject ORDER BY rank)) SELECT subject, rank, max(CASE WHEN a_intersect_b <> fi THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY rank) = 0 AS leading_tie, neighbour_tie FROM z",
        "subject_name_fold": f"WITH {D} SELECT path, CASE WHEN count(DISTINCT basename) = 1 THEN min(basename) ELSE '[various...]' END AS subject, count(*) AS n FROM files WHERE infilesha1 IS NULL GROUP BY 1",
        "wire_format_files": f"WITH {D} SELECT {rec} AS record FROM files WHERE infilesha1 IS NULL",
        "wire_format_sigs": f"WITH {D} SELECT concat_ws(';', 'S', filesha1, classname, sigsha1re, losesigsha1re) AS record FROM sigs",
        "wire_parse_roundtrip": f"WITH {D} SELECT path, basename, suffix, level, infilesha1, filesha1, doc_class AS uniqclasssigre, NULL::BIGINT AS uniqjavasigre, NULL::BIGINT AS java, NULL::BIGINT AS class FROM (SELECT *, CAST(length(path) AS BIGINT) AS doc_class FROM files WHERE infilesha1 IS NULL)",
        "known_hash_list": "SELECT (['E', 'n', 'N', 'org', 'com'])[doc_id % 5 + 1] || '.' || concat_ws('.', lang, source) AS fqn, sha1(text) AS sighash, source || '/' || lang AS path FROM documents WHERE text IS NOT NULL AND doc_id % 10 NOT IN (0, 3) AND doc_id % 5 NOT IN (1, 2)",
        "ground_truth_list": "SELECT (['jar-sha1', 'class-sha1'])[doc_id % 4 + 1] AS type, sha1(text) AS subject, CASE WHEN doc_id % 3 = 0 THEN lower(lang) ELSE sha1(text) END AS truth FROM documents WHERE text IS NOT NULL AND doc_id % 4 < 2",
        "pack_records": PACK_SQL,
        "containment_ancestors": TREE_SQL,
        "debian_version_filter": DEBIAN_SQL,
        "path_parts": PATH_SQL,
        "sorted_signature_lines": r"WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS v FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, string_agg(v, chr(10) ORDER BY translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), v) AS s FROM x WHERE v <> '' GROUP BY 1) SELECT d.doc_id, sha1(trim(coalesce(s, ''), ' ') || chr(10)) AS tight FROM documents d LEFT JOIN y USING (doc_id) WHERE text IS NOT NULL",
    }
