"""Class files and archives, made here with the JDK's compiler and Python's archive modules."""

import bz2
import hashlib
import io
import lzma
import shutil
import subprocess
import tarfile
import zipfile

import pytest

from jarloom.functions.bytecode import Types, class_signature, method_types
from jarloom.functions import names
from jarloom.sources import archives, lists
from jarloom.sources.archives import corpus_of, extract, members, scan_folder, scanned

JAVA = """package p;
import java.util.*;
public abstract class Shape<T extends Comparable<T>, U> extends AbstractList<Map.Entry<T, ? extends U[]>> implements Runnable, java.io.Serializable {
  private static final long serialVersionUID = 1L; protected transient volatile int[][] grid; List<? super T>[] many;
  public Shape(int a, String... b) throws java.io.IOException { }
  protected abstract void go(Map<String, List<T>> m, long z) throws java.io.IOException;
  public synchronized final void stop() { new Object() { int q; }; }
  public enum Color { RED, GREEN; public Color next() { return RED; } }
  interface Inner extends Runnable { int K = 1; void f(char c); }
  class Deep { Deep(int q) { } class Deeper { Shape<?, ?> s; } }
  @interface Note { String value(); }
}
"""
LINES = [
    "c;0;public abstract class p.Shape<T extends Comparable<T>,U> extends AbstractList<Entry<T,? extends U[]>> implements Runnable,Serializable",
    "f;0;  private final static long serialVersionUID;",
    "f;0;  protected transient volatile int[][] grid;",
    "f;0;  List<? super T>[] many;",
    "m;0;  public <init>(int,String[]) throws IOException",
    "m;0;  protected abstract void go(Map<String,List<T>>,long) throws IOException",
    "m;0;  public final synchronized void stop()",
    "c;1;  public enum class Color",
    "f;1;    public final static enum Color RED;",
    "f;1;    public final static enum Color GREEN;",
    "m;1;    public Color next()",
    "c;1;  interface Inner implements Runnable",
    "f;1;    public final static int K;",
    "m;1;    public void f(char)",
    "c;1;  class Deep",
    "m;1;    <init>(int)",
    "c;2;    class Deeper",
    "f;2;      Shape<?,?> s;",
    "m;2;      <init>()",
    "c;1;  interface Note",
    "m;1;    public String value()",
]


@pytest.fixture(scope="module")
def classes(tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("needs a Java compiler")
    at = tmp_path_factory.mktemp("java")
    (at / "Shape.java").write_text(JAVA)
    subprocess.run(["javac", "-d", str(at), str(at / "Shape.java")], check=True, timeout=120)
    return {f"p/{f.name}": f.read_bytes() for f in sorted((at / "p").iterdir())}


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(files, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def deb(files):
    out = b"!<arch>\n"
    for name, data in files.items():
        out += f"{name:<16}{0:<12}{0:<6}{0:<6}{'100644':<8}{len(data):<10}`\n".encode() + data + b"\n" * (len(data) % 2)
    return out


def named(classes):
    return [d for n, d in classes.items() if "$" in n and not n.endswith("$1.class")]


def test_signature(classes):
    package, name, text = class_signature(classes["p/Shape.class"], named(classes))
    head, *rest = text.split("\n")
    assert (package, name, head) == ("p", "Shape", LINES[0])
    assert sorted(rest) == sorted(LINES[1:])  # the order of inner classes is the compiler's
    assert rest[:6] == LINES[1:7]


def test_sorted_parts(classes):
    text = class_signature(classes["p/Shape.class"], named(classes), True, True, True)[2].split("\n")
    fields = [x for x in text if x.startswith("f;0")]
    assert fields == sorted(fields, key=str.lower) and sorted(text) == sorted(LINES)
    inner = [x for x in text if x.startswith("c;1")]
    assert inner == sorted(inner, key=str.lower)


def test_signatures_that_fail(classes):
    assert class_signature(classes["p/Shape.class"], [])[2].startswith("e;-1;Failed to parse [p.Shape]. Cannot find inner-class bytecode: [p.Shape.")
    for data in (b"", b"junk", classes["p/Shape.class"][:200]):
        assert class_signature(data, [])[2].startswith("e;Could not parse bytecode. [")


def test_types():
    assert method_types("(ILjava/util/Map<TK;[Ljava/lang/String;>.Entry<+TV;*>;[[J)V^TE;") == ("void,E", "int,Entry<? extends V,?>,long[][]")
    assert Types("<T:Ljava/lang/Object;:Ljava/lang/Runnable;E::Ljava/util/List<-TT;>;>").parameters() == "<T, extends Runnable,E extends List<? super T>>"


@pytest.mark.parametrize("name", ["a.zip", "a.jar", "a.war", "a.ear", "a.tar", "a.tar.gz", "a.tgz", "a.tar.bz2", "a.tar.xz", "a.tar.lzma", "a.deb"])
def test_members(name):
    files = {"x.txt": b"one", "y.bin": b"", "z.txt": b"two2"}
    make = {"a.tar": tarred, "a.tar.gz": lambda f: tarred(f, "w:gz"), "a.tgz": lambda f: tarred(f, "w:gz"), "a.tar.bz2": lambda f: bz2.compress(tarred(f)), "a.tar.xz": lambda f: lzma.compress(tarred(f)),
            "a.tar.lzma": lambda f: lzma.compress(tarred(f), lzma.FORMAT_ALONE), "a.deb": deb}.get(name, zipped)
    assert dict(members(name, make(files))) == files


def test_nested(classes):
    jar = zipped(classes | {"p/package-info.class": b"", "q/Lost$In.class": b"x", "src/A.java": b"class A {}", "readme.txt": b"r"})
    outer = tarred({"lib/in.jar": jar, "bad.zip": b"not a zip"}, "w:gz")
    rows = list(scanned("all.tar.gz", outer, -1, None, "/x/all.tar.gz", True, {}))
    sha = hashlib.sha1(jar).hexdigest()
    assert [(r[0], r[1], r[2], r[3], r[7]) for r in rows] == [("all.tar.gz", "all", ".tar.gz", -1, "archive"), ("lib/", "in", ".jar", 0, "archive"), ("p/", "Shape", ".class", 1, "bin"), ("src/", "A", ".java", 1, "src"),
                                                                ("bad.zip", "bad", ".zip", 0, "archive"), ("bad.zip", "bad", ".zip", 0, "error")]
    assert rows[2][4] == sha and rows[2][6] == "/x/all.tar.gz!/lib/in.jar!/p/Shape.class;Shape"
    ordered = [classes["p/Shape.class"], *(classes[n] for n in sorted(classes, key=str.lower) if "$" in n and not n.endswith("$1.class"))]
    assert rows[2][5] == hashlib.sha1(b"".join(ordered)).hexdigest()
    assert [r[7] for r in scanned("all.tar.gz", outer, -1, None, "/x/all.tar.gz", False, {})] == ["archive"]


def test_folder_to_corpus(spark, classes, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a-1.jar").write_bytes(zipped(classes))
    (tmp_path / "in" / "b-1.zip").write_bytes(zipped(classes | {"other.class": b"junk"}))
    (tmp_path / "empty.jar").write_bytes(b"")
    (tmp_path / "note.txt").write_bytes(b"note")
    for name, data in classes.items():
        (tmp_path / name.split("/")[1]).write_bytes(data)
    found = extract(scan_folder(spark, str(tmp_path)))
    got = found.orderBy("fullpath").collect()
    assert sorted((r.basename, r.kind) for r in got) == [("Shape", "bin"), ("Shape", "bin"), ("Shape", "bin"), ("a-1", "archive"), ("b-1", "archive"), ("other", "error")]
    assert len({r.signature for r in got if r.kind == "bin"}) == 1
    files, sigs = corpus_of(found)
    assert files.count() == 6 and sigs.count() == 1
    s = sigs.first()
    text = next(r.signature for r in got if r.kind == "bin")
    assert s.sigsha1re == hashlib.sha1((text + "\n").encode()).hexdigest()
    assert s.losesigsha1re == hashlib.sha1((text.replace("class p.Shape", "class Shape", 1) + "\n").encode()).hexdigest()


def test_no_files(spark):
    assert extract(spark.createDataFrame([], "path string, content binary")).count() == 0


def jar_of(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("_", "."), data)
    return out.getvalue()


def test_entries_of_nested_archives(spark):
    inner = jar_of(a_txt=b"A")
    df = spark.createDataFrame([("x/o.jar", jar_of(in_zip=inner, b_txt=b"B")), ("x/no.txt", b"q")], "path string, content binary")
    got = {(r.archive, r.path, r.level, bytes(r.content)) for r in archives.entries(df).collect()}
    assert got == {("x/o.jar", "in.zip", 0, inner), ("x/o.jar", "b.txt", 0, b"B"), ("x/o.jar!/in.zip", "a.txt", 1, b"A")}
    assert {r.path for r in archives.entries(df, recursive=False).collect()} == {"in.zip", "b.txt"}


def test_one_archive_and_duplicates(spark):
    df = spark.createDataFrame([("a.jar", b"1"), ("b.zip", b"2"), ("c.class", b"3"), ("d/a.jar", b"1")], "path string, content binary")
    kept, skipped = archives.one_archive(df)
    assert {r.path for r in kept.collect()} == {"a.jar", "c.class"}
    assert {r.record for r in skipped.collect()} == {"E;Skipped: [b.zip].  recursiveZips is set to false.", "E;Skipped: [d/a.jar].  recursiveZips is set to false."}
    assert {r.path for r in archives.distinct_archives(df).collect()} == {"a.jar", "b.zip", "c.class"}
    assert archives.one_archive(df.filter("path = 'c.class'"))[0].count() == 1


def test_paths_classes_and_text(spark, tmp_path):
    (tmp_path / "x.jar").write_bytes(jar_of(**{"A_java": b"package p.q; class A { int x; } class B { java.util.List<String> y; }"}))
    (tmp_path / "bad.java").write_bytes(b"class {")
    listed = lists.query_list(spark.createDataFrame([(f"1;file:{tmp_path}/x.jar",), (f"file:{tmp_path}/bad.java",)], "value string"))
    rows = extract(archives.scan_paths(spark, listed))
    target = rows.filter("classname = 'B'").first().fullpath
    assert target.endswith("x.jar!/A.java;B")
    one = archives.class_of(rows, target).collect()
    assert [r.classname for r in one] == ["B"] and archives.class_of(rows, target.removesuffix(";B")).first().classname == "A"
    assert archives.below(rows, target[:-1]).count() == 2
    assert [r.classname for r in archives.in_class_order(rows.filter("kind = 'src'")).collect()] == ["A", "B"]
    text = archives.signature_text(archives.class_of(rows, target), loose=True).first().text
    assert text.startswith(f"\nn;{target}\nc;0;class B\nf;0;  List<String> y;\n")
    assert all(r.record.startswith("E;") and "\n" not in r.record for r in archives.error_records(rows).collect()) and archives.error_records(rows).count() == 1
    files, sigs = corpus_of(rows)
    assert sigs.filter("sigsha1re <> losesigsha1re").count() == 2


def test_loose_signatures(spark):
    given = {"c;0;public class a.b.C<T extends x.y.Z>\nm;0;  p.Q r()": "c;0;public class C<T extends x.y.Z>\nm;0;  p.Q r()", "c;0;interface a.B<x.Y<z.W>>": "c;0;interface B<Y<W>>", "c;0;class C$D extends q.R\t": "c;0;class D extends q.R", "e;class a.B": "e;class a.B", "c;0;class Plain": "c;0;class Plain"}
    df = spark.createDataFrame([(k,) for k in given], "s string")
    assert {r.s: r.t for r in df.select("s", names.loose_signature(df.s).alias("t")).collect()} == given
    one = df.select(names.tight_hash(df.s).alias("h")).first().h
    assert one == hashlib.sha1((next(iter(given)) + "\n").encode()).hexdigest()
