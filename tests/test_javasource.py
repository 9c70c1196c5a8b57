import shutil
import subprocess

import pytest

from jarloom.functions.bytecode import class_signature
from jarloom.functions.javasource import source_signatures
from tests.test_archives import JAVA

MORE = """/* a */ package p.q; // b
import static java.lang.Math.*;
@SuppressWarnings({"x{", "y"}) public final class Shape extends Object {
  static { int q = 1; }
  java.util.Map<String, java.util.List<int[]>> m = new java.util.HashMap<String, java.util.List<int[]>>(), n[] = null;
  boolean less = 1 < 2, more = 3 > 2; char c = '"', d = '\\''; String s = "}\\"{";
  private Shape(final String... a) {} protected <T extends Exception> T[] go(@Deprecated T a, int[] b[]) throws java.io.IOException { if (1 < 2) { return null; } return null; }
  interface Api { int K = 1, L = 2; void f(); class In { } enum E { A } }
  private enum Op implements Runnable { ADD("+") { public void run() { } }, SUB("-") { public void run() { } }; final String t; Op(String t) { this.t = t; } }
  protected static class Nest { }
  abstract static class Strict { void f() { } abstract int g(); native int h(); }
}
class Second { }
"""


def compiled(text, at):
    (at / "Shape.java").write_text(text)
    subprocess.run(["javac", "-nowarn", "--release", "8", "-d", str(at), str(at / "Shape.java")], check=True, timeout=120)
    files = sorted(at.rglob("Shape*.class"))
    inner = [f.read_bytes() for f in files if "$" in f.name and not f.stem.rsplit("$", 1)[1].isdigit()]
    return class_signature(next(f for f in files if f.name == "Shape.class").read_bytes(), inner, True, True, True)


@pytest.mark.parametrize("text", [JAVA, MORE])
def test_same_as_compiled(text, tmp_path):
    if not shutil.which("javac"):
        pytest.skip("needs a Java compiler")
    assert source_signatures(text, True, True, True)[0] == compiled(text, tmp_path)


def test_top_level_classes():
    assert [x[:2] for x in source_signatures(MORE)] == [("p.q", "Shape"), ("p.q", "Second")]
    assert source_signatures(MORE)[1][2] == "c;0;class p.q.Second\nm;0;  <init>()"
    assert source_signatures("") == source_signatures("// nothing\npackage a;") == []


@pytest.mark.parametrize("text", ["class", "class A {", "class A { int }", "class A { String s = \"x; }", "/* open", "class A { void f( { } }", "what is this", "class A { } }"])
def test_sources_that_fail(text):
    (got,) = source_signatures(text)
    assert got[2].startswith("e;Failed to parse Java. [")


def test_strictfp():  # class files don't keep it for a class, so compiled ones can differ
    got = source_signatures("abstract strictfp class A { strictfp void f() { } } class B { strictfp void f() { } }")
    assert [x[2].split("\n")[-1] for x in got] == ["m;0;  void f()", "m;0;  strictfp void f()"] and got[0][2].startswith("c;0;abstract strictfp class A\n")


def test_enum_as_a_name():
    assert source_signatures("class A { void f(Enumeration enum) { } }")[0][2].endswith("m;0;  void f(Enumeration)")
