"""Archives of classes to rows: zips and tars, nested ones, Debian packages, single class and source files."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytecode import class_signature
from ..functions.javasource import source_signatures
from ..functions.names import loose_hash, loose_signature, tight_hash

# fixed values: suffixes of what is scanned
ZIPS = (".zip", ".war", ".ear", ".jar")
TARS = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz", ".tar.lzma")
OTHERS = (".deb", ".class", ".java")
ROWS = "path string, basename string, suffix string, level int, infilesha1 string, filesha1 string, fullpath string, kind string, package string, classname string, signature string, error string"
ANONYMOUS = re.compile(r"\$[0-9]+\.class$")
SUFFIX = re.compile(r"(\.tar\.[^.]*|\.[^.]*)$")
FAILURES = (zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, zlib.error, OSError, EOFError, ValueError, RuntimeError, NotImplementedError)


def is_archive(name: str) -> bool:
    return name.lower().endswith((*ZIPS, *TARS, ".deb"))


def ar_members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Members of an ar archive, of which Debian packages consist: headers of 60 bytes, contents on even places."""
    if not data.startswith(b"!<arch>\n"):
        raise ValueError("not an ar archive")
    at = 8
    while at + 60 <= len(data):
        name, size = data[at : at + 16].decode("latin-1").strip().rstrip("/"), int(data[at + 48 : at + 58])
        yield name, data[at + 60 : at + 60 + size]
        at += 60 + size + size % 2


def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """Files in an archive, whose kind goes by its name."""
    low = name.lower()
    if low.endswith(ZIPS):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, z.read(info)
    elif low.endswith(".deb"):
        yield from ar_members(data)
    else:
        plain = gzip.decompress(data) if low.endswith(("gz", ".tgz")) else bz2.decompress(data) if low.endswith("bz2") else lzma.decompress(data) if low.endswith(("xz", "lzma")) else data
        with tarfile.open(fileobj=io.BytesIO(plain), mode="r:") as t:
            for info in t:
                if info.isfile():
                    yield info.name.removeprefix("./"), t.extractfile(info).read()


def row(path: str, level: int, inside: str | None, sha: str, full: str, kind: str, package: str | None = None, cls: str | None = None, signature: str | None = None, error: str | None = None) -> tuple:
    name = re.split(r"[/\\]", path)[-1]
    found = SUFFIX.search(name)
    folder = path[: path.rindex("/") + 1] if "/" in path else path
    return folder, name[: found.start()] if found else name, found.group().lower() if found else "", level, inside, sha, full, kind, package, cls, signature, error


def of_classes(files: list[tuple[str, bytes]], level: int, inside: str | None, at: str, sorts: dict) -> Iterator[tuple]:
    """A row for each outer class with its named inner classes; inner ones without an outer one, and package-info, are left out."""
    own: dict[str, list[tuple[str, bytes]]] = {}
    for path, data in files:
        if "$" in path and not ANONYMOUS.search(path):
            own.setdefault(re.sub(r"\$.*", ".class", path), []).append((path, data))
    for path, data in files:
        if "$" in path or path.upper().endswith("PACKAGE-INFO.CLASS"):
            continue
        inner = [d for _, d in sorted(own.get(path, []), key=lambda x: (x[0].lower(), x[0]))]
        package, cls, text = class_signature(data, inner, **sorts)
        sha = hashlib.sha1(b"".join([data, *inner])).hexdigest()
        failed = text.startswith("e;")
        yield row(path, level, inside, sha, f"{at}{path};{cls}", "error" if failed else "bin", package, cls, None if failed else text, text if failed else None)


def scanned(path: str, data: bytes, level: int, inside: str | None, full: str, recursive: bool, sorts: dict) -> Iterator[tuple]:
    """Rows of one file: of an archive its own, then those of archives in it, then those of its classes and sources."""
    sha = hashlib.sha1(data).hexdigest()
    if path.lower().endswith(".class"):
        yield from of_classes([(path, data)], level, inside, full[: len(full) - len(path)], sorts)
    elif path.lower().endswith(".java"):
        if not path.upper().endswith("PACKAGE-INFO.JAVA"):
            for package, cls, text in source_signatures(data.decode("utf-8", "replace"), **sorts):
                failed = text.startswith("e;")
                yield row(path, level, inside, sha, f"{full};{cls}", "error" if failed else "src", package, cls, None if failed else text, text if failed else None)
    elif is_archive(path):
        yield row(path, level, inside, sha, full, "archive")
        classes, sources = [], []
        try:
            for name, content in members(path, data):
                low = name.lower()
                if low.endswith(".class"):
                    classes.append((name, content))
                elif low.endswith(".java"):
                    sources.append((name, content))
                elif is_archive(name) and (recursive or low.endswith(TARS) and path.lower().endswith(".deb")):
                    yield from scanned(name, content, level + 1, sha, f"{full}!/{name}", recursive, sorts)
        except FAILURES as e:
            yield row(path, level, inside, sha, full, "error", error=f"{type(e).__name__}: {e}")
        yield from of_classes(classes, level + 1, sha, f"{full}!/", sorts)
        for name, content in sources:
            yield from scanned(name, content, level + 1, sha, f"{full}!/{name}", recursive, sorts)
    else:
        yield row(path, level, inside, sha, full, "error", error="unknown type")


def extract(files: DataFrame, recursive: bool = True, **sorts: bool) -> DataFrame:
    """files (path, content), as the binaryFile source gives them, to rows of archives, classes and errors; sorts: sort_fields, sort_methods, sort_inner.

    An archive is one task's work, whatever is nested in it, and its rows leave in batches of 500. Class files that are rows by themselves are gathered by their folder
    and outer class. A row has the record format's columns, the class's package, name and signature, and the error if it has none; a source has a row for each of its top-level classes. Null contents are left out.
    """
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    loose = F.lower(name).endswith(".class")
    files = files.filter("content is not null").select("path", "content", name.alias("name"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for b in batches:
            for path, data, short in zip(b["path"], b["content"], b["name"], strict=True):
                for r in scanned(short, data, -1, None, path, recursive, sorts):
                    out.append(r)
                    if len(out) == 500:
                        yield pd.DataFrame(out, columns=COLUMNS)
                        out = []
        yield pd.DataFrame(out, columns=COLUMNS)

    def together(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(of_classes(sorted(zip(b["name"], b["content"], strict=True)), -1, None, key[0], sorts)), columns=COLUMNS)

    folder = F.regexp_extract("path", r"^(.*[/\\])?", 0)
    by_outer = files.filter(loose).groupBy(folder.alias("folder"), F.regexp_replace("name", r"(\$.*|\.class)$", "").alias("outer"))
    return files.filter(~loose).mapInPandas(run, ROWS).unionByName(by_outer.applyInPandas(together, ROWS))


COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder, not empty, with a suffix that is scanned."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return x.filter((F.col("length") > 0) & F.lower("path").rlike("(" + "|".join(re.escape(s) for s in (*ZIPS, *TARS, *OTHERS)) + ")$")).select("path", "content")


def scan_paths(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """The files of a list of paths (path), such as query_list() gives; folders in it are searched as scan_folder() does. The list is what someone has typed or piped in, and
    comes to the driver; the files do not."""
    found = [r.path for r in paths.select("path").distinct().orderBy("path").collect()]
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(found) if found else spark.createDataFrame([], "path string, length long, content binary")
    return x.filter("length > 0").select("path", "content")


def one_archive(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (path, content) without archives but the first by path, and E records of those that are left out."""
    is_one = F.lower("path").rlike("(" + "|".join(re.escape(s) for s in (*ZIPS, *TARS, ".deb")) + ")$")
    rest = is_one & (F.col("path") != F.lit(files.filter(is_one).agg(F.min("path")).first()[0]))
    rest = F.coalesce(rest, F.lit(False))  # no archive at all
    return files.filter(~rest), files.filter(rest).select(F.concat(F.lit("E;Skipped: ["), "path", F.lit("].  recursiveZips is set to false.")).alias("record"))


def distinct_archives(files: DataFrame) -> DataFrame:
    """files (path, content) with one of those that have the same content, base name and size: the first by path."""
    x = files.withColumns({"sha": F.sha1("content"), "name": F.regexp_extract("path", r"([^/\\]*)$", 1), "size": F.length("content")})
    least = x.groupBy("sha", "name", "size").agg(F.min("path").alias("path")).select("path")
    return files.join(least, "path", "left_semi")


def entries(files: DataFrame, recursive: bool = True) -> DataFrame:
    """files (path, content) to what archives hold: archive, path, level, content. An archive is one task's work; with recursive, archives in it are opened too."""

    def opened(archive: str, name: str, data: bytes, level: int) -> Iterator[tuple]:
        for path, content in members(name, data):
            yield archive, path, level, content
            if recursive and is_archive(path):
                yield from opened(f"{archive}!/{path}", path, content, level + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                for r in opened(path, path, data, 0):
                    yield pd.DataFrame([r], columns=["archive", "path", "level", "content"])

    return files.filter("content is not null").filter(F.lower("path").rlike("(" + "|".join(re.escape(s) for s in (*ZIPS, *TARS, ".deb")) + ")$")).select("path", "content").mapInPandas(run, "archive string, path string, level int, content binary")


def class_of(rows: DataFrame, target: str) -> DataFrame:
    """Of rows of extract() the class that a target names: archive!/path;Class, or a path alone for its only class. The first by its full name, if there are several."""
    named = ";" in target.rsplit("/", 1)[-1]
    return rows.filter(F.col("kind").isin("bin", "src")).filter(F.col("fullpath") == target if named else F.col("fullpath").startswith(target + ";")).orderBy("fullpath").limit(1)


def below(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows whose full path begins with a target's."""
    return rows.filter(F.col("fullpath").startswith(prefix))


def error_records(rows: DataFrame) -> DataFrame:
    """E;path;message of rows that failed, newlines as blanks."""
    return rows.filter("error is not null").select(F.concat_ws(";", F.lit("E"), F.concat("path", "basename", "suffix"), F.translate("error", "\n", " ")).alias("record"))


def signature_text(rows: DataFrame, loose: bool = False) -> DataFrame:
    """Signatures as text: a blank line, n;path, and the signature's lines, with loose without packages in the class's name."""
    body = loose_signature(F.col("signature")) if loose else F.col("signature")
    return rows.filter("signature is not null").select("fullpath", F.concat(F.lit("\nn;"), "fullpath", F.lit("\n"), body).alias("text"))


def in_class_order(rows: DataFrame) -> DataFrame:
    """Rows by package and class name."""
    return rows.orderBy("package", "classname", "fullpath")


def corpus_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of extract() to the tables files and sigs, each of distinct rows."""
    files = rows.filter("kind <> 'error' or classname is not null").select("path", "basename", "suffix", "level", "infilesha1", "filesha1").distinct()
    sigs = rows.filter("signature is not null").select("filesha1", "classname", tight_hash(F.col("signature")).alias("sigsha1re"), loose_hash(F.col("signature")).alias("losesigsha1re")).distinct()
    return files, sigs
