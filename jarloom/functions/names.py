"""Names, paths and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fix_class_name(c: Column) -> Column:
    """Slashes and dollar signs become dots."""
    return F.translate(c, "/$", "..")


def name_from_path(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def strip_generic(c: Column) -> Column:
    return F.substring_index(c, "<", 1)


def relative_path(c: Column) -> Column:
    """The directory with its slash; a name without one stands for itself."""
    return F.when(c.contains("/"), F.regexp_extract(c, r"^(.*/)", 1)).otherwise(c)


def suffix(c: Column) -> Column:
    """Lower-cased, with its dot; .tar.X is one suffix."""
    return F.lower(F.regexp_extract(name_from_path(c), r"(\.tar\.[^.]*|\.[^.]*)$", 1))


def base_name(c: Column) -> Column:
    return F.regexp_replace(name_from_path(c), r"(\.tar\.[^.]*|\.[^.]*)$", "")


def zip_level(c: Column, tar_level: Column | None = None) -> Column:
    """How deep in archives: exclamation marks less one; one more than their number below the tar's level, if the archive was found in a tar (tar_level not null)."""
    marks = F.length(c) - F.length(F.replace(c, F.lit("!"), F.lit("")))
    return (marks - 1 if tar_level is None else F.coalesce(tar_level + marks + 1, marks - 1)).cast("int")


def ultimate_parent(c: Column) -> Column:
    """The class file that holds an inner one, however deep; null for a name without a dollar sign."""
    return F.when(c.contains("$"), F.concat(F.substring_index(c, "$", 1), F.lit(".class")))


def immediate_parent(c: Column) -> Column:
    """The class file that an inner one is directly in; null for a name without a dollar sign."""
    return F.when(c.contains("$"), F.concat(F.regexp_extract(c, r"^(?s)(.*)\$", 1), F.lit(".class")))


def is_inner_class(c: Column) -> Column:
    return c.endswith(".class") & c.contains("$")


def is_anonymous_class(c: Column) -> Column:
    return c.rlike(r"\$[0-9]+\.class$")


def is_package_info(c: Column) -> Column:
    return F.upper(c).rlike(r"PACKAGE-INFO\.(CLASS|JAVA)$")


def family(c: Column) -> Column:
    """Up to the first dot, then up to the last hyphen."""
    head = F.substring_index(c, ".", 1)
    return F.regexp_replace(head, r"-[^-]*$", "")


def trimmed(c: Column) -> Column:
    """Without blanks and control characters at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def tight_hash(signature: Column) -> Column:
    return F.sha1(F.concat(trimmed(signature), F.lit("\n")))


def fix_type_name(c: Column) -> Column:
    """A type expression without packages and outer classes, in type arguments too; one without any stays as it is."""
    fixed = fix_class_name(c)
    for _ in range(2):  # type arguments of outer classes, those of arguments first
        fixed = F.regexp_replace(fixed, r"<[^<>]*(?:<[^<>]*>[^<>]*)*>\.", ".")
    return F.when(fixed.contains("."), F.regexp_replace(fixed, r"[^. <>,\[\]]*\.", "")).otherwise(c)


def fqn(package: Column, name: Column) -> Column:
    return F.when(package == "", name).otherwise(F.concat(package, F.lit("."), name))


def loose_signature(signature: Column) -> Column:
    """The signature with the type rule applied to the name that follows class or interface in its first line; errors stay as they are."""
    s = trimmed(signature)
    words = F.split(F.substring(F.substring_index(s, "\n", 1), 5, 2**30), " ")
    place = F.array_min(F.filter(F.transform(words, lambda w, k: F.when((k > 0) & F.get(words, k - 1).isin("class", "interface"), k)), lambda k: k.isNotNull()))
    line = F.concat(F.substring(s, 1, 4), F.array_join(F.transform(words, lambda w, k: F.when(k == place, fix_type_name(w)).otherwise(w)), " "))
    rest = F.when(s.contains("\n"), F.concat(F.lit("\n"), F.regexp_extract(s, r"^[^\n]*\n((?s).*)$", 1))).otherwise("")
    return F.when(F.lower(F.substring(s, 1, 1)) == "e", s).otherwise(F.concat(trimmed(line), rest))


def loose_hash(signature: Column) -> Column:
    return F.sha1(F.concat(loose_signature(signature), F.lit("\n")))


def old_loose_line(line: Column) -> Column:
    """The older loose rule for a line: a class line loses its first dotted prefix; other lines stay."""
    return F.when(line.startswith("c;"), F.regexp_replace(line, r"^((?s).*?)(?:[^. ]+\.)+", "$1")).otherwise(line)


def extract_version(archive: Column, path: Column) -> Column:
    """The last folder or file of a path that begins with a digit; else, with a star, the archive's name from its first part (between hyphens) that does, without its
    suffix; else, with two, what follows its last hyphen. Empty if there is nothing of the kind."""
    digit = lambda s: trimmed(s).rlike(r"^\p{Nd}")
    own = F.try_element_at(F.filter(F.split(path, "/"), digit), F.lit(-1))
    parts = F.split(archive, "-")
    k = F.array_min(F.filter(F.transform(parts, lambda s, n: F.when(digit(s), n)), lambda n: n.isNotNull()))
    named = F.array_join(F.transform(F.slice(parts, k + 1, F.size(parts)), lambda s, n: F.when(n == 0, trimmed(s)).otherwise(s)), "-")
    tail = F.regexp_extract(archive, r"^(?:(?s).*)-([^-]*)$", 1)
    tail = F.when((tail != "") & ~F.regexp_extract(archive, r"^((?s).*)-[^-]*$", 1).contains("."), tail).otherwise(F.when(tail.contains("."), tail).otherwise(F.lit("")))
    return F.coalesce(trimmed(own), F.when(k.isNotNull(), F.concat(F.lit("*"), F.regexp_replace(named, r"\.[^.]*$", ""))), F.when(tail != "", F.concat(F.lit("**"), F.regexp_replace(tail, r"\.[^.]*$", ""))), F.lit(""))


def strip_path_and_suffix(c: Column) -> Column:
    """The file's name without what begins at its last .tar., if that is under eight characters, or else without jar, zip, tgz, war or ear."""
    name = F.regexp_extract(c, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?:\.tar\..{0,2}|\.(?:jar|zip|tgz|war|ear))$", "")


def normalize_name(c: Column) -> Column:
    """Digits, letters and dots."""
    return F.regexp_replace(c, r"[^\p{Nd}\p{L}.]", "")


def loose_text(line: Column) -> Column:
    """A-Z lower-cased, blanks removed."""
    return F.replace(F.translate(line, *LOWER), F.lit(" "), F.lit(""))


def milli(i: Column, d: Column) -> Column:
    """i / d in thousandths, half up; null for d = 0. Integer arithmetic, so that ranks don't hang on floating point."""
    return F.when(d > 0, F.call_function("div", 2000 * i + d, 2 * d))


def ratio_text(m: Column) -> Column:
    return F.concat(F.call_function("div", m, F.lit(1000)).cast("string"), F.lit("."), F.lpad((m % 1000).cast("string"), 3, "0"))
