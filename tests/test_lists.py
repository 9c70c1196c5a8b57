import pytest

from jarloom.sources import lists


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_known_hashes(spark):
    got = lists.known_hashes(lines(spark, "a.B;h;p", "", "E;x;y", "name.C;h;p", "Nope;h;p", "c.D;h2", "alone")).collect()
    assert sorted(map(tuple, got), key=str) == [("a.B", "h", "p"), ("c.D", "h2", None)]


def test_truth(spark):
    t = lists.ground_truth(lines(spark, "JAR-SHA1;_;AB", "class-sha1;_;ab;CD", "class-sha1;_;ef; GH ", "# no", "what;_;x", "", "jar-sha1;_;"))
    assert sorted(map(tuple, t.collect())) == [("class-sha1", "ab", "cd"), ("class-sha1", "ef", "gh"), ("jar-sha1", "ab", "ab")]
    got = lists.truth_of(spark.createDataFrame([("ab",), ("ef",), ("zz",)], "subject string"), t).collect()
    assert sorted(map(tuple, got), key=str) == [("ab", "ab", "JAR-SHA1-TRUTH"), ("ef", "gh", "CLASS-SHA1-TRUTH"), ("zz", None, "NEW-ANALYSIS")]


def test_queries_and_hashes(spark):
    assert sorted(map(tuple, lists.query_list(lines(spark, "3;/a/b;c.jar", " /d.jar ", "")).collect()), key=str) == [(3, "/a/b;c.jar"), (None, "/d.jar")]
    got = lists.sha1_listing(spark.createDataFrame([("a", b"abc"), ("b", None)], "path string, content binary")).collect()
    assert sorted(r.record for r in got) == ["SHA1;a;0;a9993e364706816aba3e25717850c26c9cd0d89d", "SHA1;b;-1;"]


def test_pack_records(spark):
    given = ["Z;0;/x/a.zip;z1", "P;0;m.jar;m;./;.jar;/s;h1", "Z;1;m.jar;z2", "P;1;A.class;A;./;.class;/s;h2", "S;h2;A;t;l", "F;./;A;.class;?;?;h2", "T;9"]
    df = spark.createDataFrame([(1, n, v) for n, v in enumerate(given)], "stream int, pos int, value string").repartition(4)
    assert [r.record for r in lists.pack_records(df).orderBy("pos").collect()] == ["F;/x/;a;.zip;-1;NULL;z1;NULL;NULL;NULL;NULL", "F;./;m;.jar;0;z1;h1;NULL;NULL;NULL;NULL", "S;h2;A;t;l", "F;./;A;.class;1;z2;h2"]


def test_debian(spark):
    good = ["pool/liba_1.2-3_all.deb/data.tar.gz/usr/a-1.2.jar", "p/libb_2.0~beta1+dfsg-1_all.deb/data.tar.xz/b-2.0-beta-1.jar", "p/libc_1.6.dfsg-1_all.deb/data.tar.bz2/c-1.6.dfsg0.jar"]
    bad = ["pool/liba_1.2-3_all.deb/data.tar.gz/usr/a-1.3.jar", "nothing", "p/a_1.2-3.deb/control/a-1.2.jar"]
    assert sorted(r.value for r in lists.debian_matches(lines(spark, *good, *bad)).collect()) == sorted(good)
    index = lines(spark, "Filename: pool/a/ant_1.0-1_all.deb", "Filename: pool/a/ant-dev_1.0_all.deb", "Filename: pool/ivy/ivy_1_all.deb", "Filename: o/ivy_2.deb", "Filename: lib/libivy_1.deb", "Filename: a/two_1.deb", "Filename: b/two_2.deb", "Size: 3")
    got = lists.debian_index(lines(spark, "ant", "ivy", "none", "two").withColumnRenamed("value", "name"), index, "m/").collect()
    assert sorted(map(tuple, got)) == [("ant", "m/pool/a/ant_1.0-1_all.deb"), ("ivy", "m/pool/ivy/ivy_1_all.deb"), ("none", None), ("two", None)]


def test_debian_index_broadcasts_no_table(spark):
    """Neither names nor beginnings, which Catalyst takes to be few, go through the driver."""
    found = lists.debian_index(lines(spark, "ant", "a").withColumnRenamed("value", "name"), lines(spark, "Filename: pool/a/ant_1.0.deb", "Filename: x//ant_1.0.deb"), "m/")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("a", "m/pool/a/ant_1.0.deb"), ("ant", None)]


def test_ancestors(spark):
    f = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("c", "a")], "filesha1 string, infilesha1 string")
    assert sorted(map(tuple, lists.ancestors(f).collect())) == [("b", "a", 1), ("c", "a", 1), ("c", "a", 2), ("c", "b", 1)]
    with pytest.raises(ValueError, match="nested deeper"):
        lists.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "filesha1 string, infilesha1 string"))


def test_a_signature_of_an_unknown_file_is_an_error(spark):
    df = spark.createDataFrame([(1, n, v) for n, v in enumerate(["P;0;A.class;A;./;.class;s;h", "Z;0;x;y", "n;A.class;A", "c;0;class A"])], "stream int, pos int, value string")
    with pytest.raises(Exception, match="no record of the file A.class"):
        lists.pack_signatures(df).collect()


def test_reorder_keeps_every_line(spark):
    given = ["c;0;class Z", "m;0; a()", "c;1; class Y", "c;2; class Y", "f;2; int x", "c;1; class B", "m;1; q()", "c;0;class A", "c;0;class A", "f;0; int y"]
    got = lists.reorder_classes(spark.createDataFrame([(1, n, v) for n, v in enumerate(given)], "sig int, pos int, value string")).orderBy("place").collect()
    assert [r.value for r in got] == ["c;0;class A", "c;0;class A", "f;0; int y", "c;0;class Z", "m;0; a()", "c;1; class B", "m;1; q()", "c;1; class Y", "c;2; class Y", "f;2; int x"]


def test_shuffle_is_fixed_by_its_seed(spark):
    df = lines(spark, *map(str, range(200)))
    a, b, c = ([r.value for r in lists.shuffled(df.repartition(n), seed).collect()] for n, seed in ((3, 1), (7, 1), (3, 2)))
    assert a == b != c and sorted(a) == sorted(map(str, range(200))) and a != sorted(a)
