"""Text lists: known hashes, ground truth, queries, hashes of files, and the older record stream of packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import old_loose_line


def field(k: int) -> Column:
    return F.get(F.split("value", ";"), F.lit(k))


def known_hashes(lines: DataFrame) -> DataFrame:
    """Lines (value) FQN;HASH;PATH to fqn, sighash, path. Blank lines and those that begin with E; or with n or N don't count, nor do those of fewer than two fields."""
    x = lines.filter("trim(value) <> ''").filter(~F.col("value").startswith("E;") & ~F.lower("value").startswith("n"))
    return x.select(field(0).alias("fqn"), field(1).alias("sighash"), field(2).alias("path")).filter("sighash is not null")


def ground_truth(lines: DataFrame) -> DataFrame:
    """Lines type;_;subject[;truth] to type, subject, truth, in lower case; without a truth the subject is the truth. # begins a comment; types are jar-sha1 and class-sha1."""
    x = lines.filter("trim(value) <> ''").filter(~F.trim("value").startswith("#")).select(F.lower(F.trim("value")).alias("value"))
    subject, truth = F.trim(field(2)), F.trim(field(3))
    x = x.select(F.trim(field(0)).alias("type"), subject.alias("subject"), F.coalesce(F.nullif(truth, F.lit("")), subject).alias("truth"))
    return x.filter(F.col("type").isin("jar-sha1", "class-sha1") & (F.col("subject") != ""))


def truth_of(subjects: DataFrame, truths: DataFrame) -> DataFrame:
    """subjects (subject) with truth and truth_source: what the jar-sha1 list gives, else the class-sha1 list, else null. Of several for a subject the greatest counts."""
    one = lambda t: truths.filter(F.col("type") == t).groupBy("subject").agg(F.max("truth").alias(t))
    x = subjects.join(one("jar-sha1"), "subject", "left").join(one("class-sha1"), "subject", "left")
    source = F.when(F.col("jar-sha1").isNotNull(), "JAR-SHA1-TRUTH").when(F.col("class-sha1").isNotNull(), "CLASS-SHA1-TRUTH").otherwise("NEW-ANALYSIS")
    return x.withColumns({"truth": F.coalesce("jar-sha1", "class-sha1"), "truth_source": source}).drop("jar-sha1", "class-sha1")


def query_list(lines: DataFrame) -> DataFrame:
    """Lines number;path or path to line_no (null without one) and path."""
    x = lines.select(F.trim("value").alias("value")).filter("value <> ''")
    has = F.col("value").rlike("^[0-9]+;")
    return x.select(F.when(has, field(0)).cast("long").alias("line_no"), F.when(has, F.regexp_replace("value", "^[0-9]+;", "")).otherwise(F.col("value")).alias("path"))


def sha1_listing(files: DataFrame) -> DataFrame:
    """files (path, content) to lines SHA1;path;0;digest, or SHA1;path;-1; where there is no content."""
    return files.select(F.when(F.col("content").isNull(), F.concat(F.lit("SHA1;"), "path", F.lit(";-1;"))).otherwise(F.concat(F.lit("SHA1;"), "path", F.lit(";0;"), F.sha1("content"))).alias("record"))


def pack_records(lines: DataFrame) -> DataFrame:
    """The older stream of a pack, lines (stream, pos, value), to record lines (stream, pos, record) with each file's container and level put in.

    Z;_;name;sha1 begins a container, the first of a stream is a file itself; P;level;filename;basename;path;extension;systempath;sha1 is a file, written unless it is
    a class or a source, whose own F record follows; F gets the container's sha1 as its sixth field and the last P's level as its fifth; S stays as it is; A, T, E and
    e don't count. What holds is carried on by position within a stream, so the order of rows doesn't matter; a stream is one pack's, not the corpus's.
    """
    parts = F.split("value", ";")
    x = lines.select("stream", "pos", "value", F.get(parts, F.lit(0)).alias("tag"), parts.alias("p"))
    so_far = W.partitionBy("stream").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    get = lambda k: F.get("p", F.lit(k))
    x = x.withColumns({
        "sha": F.last(F.when(F.col("tag") == "Z", get(3)), True).over(so_far),
        "level": F.last(F.when(F.col("tag") == "P", get(1)), True).over(so_far),
        "packs": F.count(F.when(F.col("tag") == "Z", 1)).over(so_far),
    })
    no = F.lit("NULL")
    nothing = lambda c: F.coalesce(c, F.lit(""))
    top = F.regexp_extract(get(2), r"^(.*/)([^/]+)(\.[^.]+)$", 1), F.regexp_extract(get(2), r"^(.*/)([^/]+)(\.[^.]+)$", 2), F.regexp_extract(get(2), r"^(.*/)([^/]+)(\.[^.]+)$", 3)
    record = (
        F.when(F.col("tag") == "S", F.col("value"))
        .when(F.col("tag") == "F", F.concat_ws(";", F.slice("p", 1, 4), nothing(F.col("level")), nothing(F.col("sha")), F.when(F.size("p") > 6, F.array_join(F.slice("p", 7, 1000), ";"))))
        .when((F.col("tag") == "Z") & (F.col("packs") == 1), F.concat_ws(";", F.lit("F"), *top, F.lit("-1"), no, get(3), *[no] * 4))
        .when((F.col("tag") == "P") & ~F.col("p")[5].isin(".class", ".java"), F.concat_ws(";", F.lit("F"), get(4), get(3), get(5), get(1), nothing(F.col("sha")), get(7), *[no] * 4))
    )
    return x.select("stream", "pos", record.alias("record")).filter("record is not null")


def debian_matches(lines: DataFrame) -> DataFrame:
    """Paths (value) of jars in Debian packages, dir/name_version-revision.deb/data.tar.gz/file.jar, whose package version is part of the jar's name."""
    x = lines.filter(F.col("value").rlike(r"\.deb/") & F.col("value").rlike(r"data\.tar\.(gz|bz2|xz)/"))
    x = x.withColumns({"pkg": F.regexp_extract(F.regexp_extract("value", r"^(.*?)\.deb/", 1), r"([^/]*)$", 1), "jar": F.regexp_extract("value", r"([^/]*)$", 1)})
    version = F.regexp_extract(F.regexp_extract("pkg", r"_(.*)$", 1), r"^(.*?)(?:\+dfsg|\.dfsg|-)", 1)
    x = x.filter(version != "").withColumn("version", F.concat(version, F.lit(".jar")))
    for old, new in (("~alpha", "-alpha-"), ("~beta", "-beta-"), ("+ds1.jar", ".jar"), ("+dak1.jar", ".jar"), ("~RC", "-RC")):
        x = x.withColumn("version", F.replace("version", F.lit(old), F.lit(new)))
    clean = lambda c: F.regexp_replace(c, "^(.*?).dfsg0?", "$1")
    x = x.withColumns({"jar": clean(F.replace("jar", F.lit("-OOo31"), F.lit(""))), "version": clean(F.col("version"))})
    return x.filter(F.col("jar").contains(F.col("version"))).select("value", "jar", "version")


def debian_index(names: DataFrame, index: DataFrame, mirror: str) -> DataFrame:
    """names (name) to the one package file of index (value, its Filename: lines) that some folder or file of begins with the name, as a url.

    Lines with the name and a hyphen after a slash, or with lib before it, don't count. Of several the one with the name twice (folder and file) counts; a name that is
    still ambiguous, or has none, gets a null url. Equal lines are one.
    """
    rows = index.filter(F.col("value").startswith("Filename: ")).select("value").distinct()
    # a folder or file begins with the name: an equality on its beginnings of the lengths that names have, no cross join. A value's beginnings are told apart in its row.
    # Catalyst takes the exploded table to be as small as its source, so it must be told not to broadcast it.
    asked = names.select("name").distinct()
    lengths = asked.agg(F.collect_set(F.length("name")).alias("lengths"))  # one row
    begins = "flatten(transform(slice(split(value, '/'), 2, 1000), p -> transform(filter(lengths, k -> k = length(p) or k between 1 and length(p)), k -> substring(p, 1, k))))"
    starts = rows.crossJoin(F.broadcast(lengths)).select("value", F.explode(F.array_distinct(F.expr(begins))).alias("name"))
    slash = lambda *c: F.col("value").contains(F.concat(*(F.lit(x) if x in ("/", "/lib", "-") else F.col(x) for x in c)))
    x = asked.join(starts.filter(~slash("/", "name", "-") & ~slash("/lib", "name")).hint("merge"), "name")
    strict = slash("/", "name", "/", "name")
    x = x.groupBy("name").agg(F.count("*").alias("n"), F.max("value").alias("any"), F.count(F.when(strict, 1)).alias("strict"), F.max(F.when(strict, F.col("value"))).alias("own"))
    url = F.concat(F.lit(mirror), F.expr("substring(CASE WHEN n = 1 THEN any WHEN strict = 1 THEN own END, 11)"))
    return asked.join(x.hint("merge"), "name", "left").select("name", url.alias("url"))


def ancestors(files: DataFrame, most: int = 16) -> DataFrame:
    """files (filesha1, infilesha1): each file with every container around it and how far out that is (1: the one it is in).

    One join a round over what is left of the chain; it ends when no file has a further container, or after `most` rounds (nesting deeper than that raises).
    """
    up = files.filter("infilesha1 is not null").select(F.col("filesha1").alias("child"), F.col("infilesha1").alias("above")).distinct()
    up = up.persist()  # a pair of hashes a file; parts that are lost are worked out again
    step = up.select(F.col("child").alias("filesha1"), F.col("above").alias("container"), F.lit(1).alias("distance"))
    out = step
    for n in range(2, most + 2):
        step = step.join(up, F.col("container") == F.col("child")).select("filesha1", F.col("above").alias("container"), F.lit(n).alias("distance")).distinct().persist()
        if step.isEmpty():
            return out
        out = out.unionByName(step)
    raise ValueError(f"archives nested deeper than {most}, or within themselves")


# fixed values: suffixes that lists of paths are searched for
KNOWN_SUFFIXES = (".jar", ".zip", ".war", ".ear", ".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.xz", ".tar.lzma", ".deb", ".class", ".java")


def known_suffix(lines: DataFrame) -> DataFrame:
    """Lines (value) that end in a suffix that is scanned, in any case."""
    low = F.lower("value")
    test = F.lit(False)
    for s in KNOWN_SUFFIXES:
        test = test | low.endswith(s)
    return lines.filter(test)


def unpack_log(lines: DataFrame, word: str) -> DataFrame:
    """Lines of a log that begin an unpacking and hold a word."""
    return lines.filter(F.col("value").contains("BeginUnpack;") & F.col("value").contains(word))


def signature_lines(lines: DataFrame) -> DataFrame:
    """Class, field and method lines."""
    return lines.filter(F.col("value").rlike("^[cfm];"))


def record_counts(lines: DataFrame) -> DataFrame:
    """How many records of each tag were read."""
    return lines.groupBy(F.substring_index("value", ";", 1).alias("tag")).agg(F.count("*").alias("n"))


def shuffled(lines: DataFrame, seed: int) -> DataFrame:
    """Lines (value) in a random order that a seed fixes: sorted by a hash of seed and line, equal lines together. The sort is by ranges, not in one task."""
    return lines.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), "value"))).orderBy("key", "value")


def last_so_far(value: Column) -> Column:
    return F.last(value, True).over(W.partitionBy("stream").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))


def pack_signatures(lines: DataFrame) -> DataFrame:
    """The stream of a pack with signatures, lines (stream, pos, value), to stream, pos, filesha1, classname, signature, loose.

    n;file;class begins a class; the c, f and m lines after it are its signature, until the next other line. The file's sha1 is that of the last P record with this file
    name (third field) in the same pack (since the last Z); a signature whose file is not known raises an error. loose has the older rule applied to class lines. Other
    tags don't count. A stream is one pack's, so its rows in order are a task's work.
    """
    parts = F.split("value", ";")
    x = lines.select("stream", "pos", "value", F.get(parts, F.lit(0)).alias("tag"), parts.alias("p"))
    body = F.col("tag").isin("c", "f", "m")
    at = lambda test: last_so_far(F.when(test, F.col("pos")))
    x = x.withColumns({"body": body, "block": at(~body), "pack": at(F.col("tag") == "Z"), "file": last_so_far(F.when(F.col("tag") == "n", F.get("p", F.lit(1)))), "classname": last_so_far(F.when(F.col("tag") == "n", F.coalesce(F.get("p", F.lit(2)), F.lit(""))))})
    x = x.withColumn("pack", F.coalesce("pack", F.lit(-1)))
    sigs = x.filter("body").groupBy("stream", "block", "pack", "file", "classname").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("ls"))
    shas = x.filter("tag = 'P'").select("stream", "pack", F.get("p", F.lit(2)).alias("file"), F.col("pos").alias("at"), F.get("p", F.lit(7)).alias("sha"))
    found = sigs.join(shas, ["stream", "pack", "file"], "left").groupBy("stream", "block").agg(F.max_by("sha", F.when(F.col("at") < F.col("pos"), F.col("at"))).alias("sha"), F.max(F.when(F.col("at") < F.col("pos"), F.col("at"))).alias("at"))
    sigs = sigs.join(found, ["stream", "block"])
    sha = F.when(F.col("at").isNull(), F.raise_error(F.concat(F.lit("no record of the file "), F.coalesce("file", F.lit("")))).cast("string")).otherwise(F.col("sha"))
    text = F.transform("ls", lambda r: F.concat(r["value"], F.lit("\n")))
    loose = F.transform("ls", lambda r: F.concat(old_loose_line(r["value"]), F.lit("\n")))
    return sigs.select("stream", "pos", sha.alias("filesha1"), "classname", F.array_join(text, "").alias("signature"), F.array_join(loose, "").alias("loose"))


def container_records(lines: DataFrame, most: int = 16) -> DataFrame:
    """The older pack output, lines (stream, pos, value) with P;level;file;base;directory;extension;container records and signatures between them, to record lines (stream,
    pos, record): P;file;;level;containers and SHA1;name;digest;file;level;containers for each n record's lines.

    The containers are a stack: a P record one level further in puts its container on it, one at the same level replaces the top, one further out only takes off. Files
    nested more than `most` deep lose the outermost ones beyond that.
    """
    parts = F.split("value", ";")
    x = lines.filter("value <> '' and value not rlike '^(>>>>>|<<<<<)'").select("stream", "pos", "value", F.get(parts, F.lit(0)).alias("tag"), parts.alias("p"))
    get = lambda k: F.get("p", F.lit(k))
    is_p = F.col("tag") == "P"
    level = F.when(is_p, get(1).cast("int"))
    before = F.lag("level", 1, -1).over(W.partitionBy("stream").orderBy("pos"))
    puts = x.filter(is_p).withColumn("level", level).withColumn("before", before).select("stream", "pos", F.when(F.col("before") <= F.col("level"), F.col("level")).alias("puts"))
    x = x.join(puts, ["stream", "pos"], "left").withColumns({"level": last_so_far(level), "file": last_so_far(F.when(is_p, get(2))), "block": last_so_far(F.when(is_p | (F.col("tag") == "n"), F.col("pos"))), "name": last_so_far(F.when(is_p, F.lit("")).when(F.col("tag") == "n", F.expr("substring(value, 3)")))})
    x = x.withColumns({f"c{k}": last_so_far(F.when(F.col("puts") == k, get(6))) for k in range(most + 1)})
    stack = F.array_join(F.slice(F.array(*(F.col(f"c{k}") for k in range(most + 1))), F.lit(1), F.col("level") + 1), ";")
    x = x.withColumn("stack", stack)
    ps = x.filter(is_p).select("stream", "pos", F.concat_ws(";", F.lit("P"), "file", F.lit(""), F.col("level").cast("string"), "stack").alias("record"))
    body = x.filter("tag not in ('P', 'n')").groupBy("stream", "block", "name", "file", "level", "stack").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("ls"))
    digest = F.sha1(F.array_join(F.transform("ls", lambda r: r["value"]), "\n"))
    return ps.unionByName(body.select("stream", "pos", F.concat_ws(";", F.lit("SHA1"), "name", digest, "file", F.col("level").cast("string"), "stack").alias("record")))


def reorder_classes(lines: DataFrame, most: int = 8) -> DataFrame:
    """Lines of signatures (sig, pos, value) in the order of their classes: siblings by their class line, with what belongs to each; members stay as they are.

    A line's key is the chain of class lines that it is in, so that one sort of a signature's lines does what a recursion would; equal class lines keep their order.
    Classes more than `most` levels in keep their places within the last of these. Gives sig, place, value; no line is lost.
    """
    parts = F.split("value", ";")
    x = lines.withColumns({"class": F.get(parts, F.lit(0)) == "c", "level": F.get(parts, F.lit(1)).cast("int")})
    so_far = W.partitionBy("sig").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    chain = F.array(*(F.last(F.when(F.col("class") & (F.col("level") == k), F.struct(F.col("value").alias("line"), F.col("pos").alias("at"))), True).over(so_far) for k in range(most)))
    x = x.withColumn("chain", F.slice(chain, F.lit(1), F.least(F.col("level") + 1, F.lit(most))))
    place = F.row_number().over(W.partitionBy("sig").orderBy("chain", "pos"))
    return x.select("sig", place.cast("long").alias("place"), "value")
