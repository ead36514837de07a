"""Text normalisation, hashing, versions and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def key(value: Column) -> Column:
    """Lower case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def scalar(value: Column) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(value, r"^\s+|\s+$", ""), r"\s+", " "))


def squeezed(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"\s+", "")


def neutral(value: Column) -> Column:
    """Spreadsheet formulas made text: a quote before a leading = + - @."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL; a null part counts as empty text, never as absent."""
    joined = F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.sha2(joined, 256)


def iso_date(value: Column) -> Column:
    """A date from strict yyyy-mm-dd, else null."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date"))


def compact_date(value: Column) -> Column:
    return F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def version_relation(version: Column, current: str) -> Column:
    """compatible, migration_required, future_minor, other_major or invalid: versions are major.minor[.patch]."""
    major, minor = (int(x) for x in current.split(".")[:2])
    ok = version.rlike(r"^\d{1,9}\.\d{1,9}(\.\d{1,9})?$")
    at = lambda i: F.try_element_at(F.split(version, r"\."), F.lit(i)).try_cast("int")
    return F.when(~F.coalesce(ok, F.lit(False)), "invalid").when(at(1) != major, "other_major").when(at(2) > minor, "future_minor").when(at(2) < minor, "migration_required").otherwise("compatible")


def first_tag(xml: Column, tag: str) -> Column:
    """The text of the first element of that name, whatever its prefix; null if absent or empty."""
    return F.nullif(F.regexp_replace(F.regexp_extract(xml, rf"(?is)<(?:[\w.-]+:)?{tag}\b(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?{tag}>", 1), r"^\s+|\s+$", ""), F.lit(""))


def nested_tag(xml: Column, *path: str) -> Column:
    for tag in path:
        xml = first_tag(xml, tag)
    return xml


def unfenced(value: Column) -> Column:
    """The outermost bracketed span of a text, whether or not it stands in a code fence; null if it has none."""
    plain = F.regexp_replace(value, r"(?m)^\s*```\w*\s*$", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)[\{\[].*[\}\]]", 0), F.lit(""))


def pdf_strings(content: Column) -> Column:
    """The shown strings (Tj) of an uncompressed PDF page, escapes of brackets undone, one blank between them."""
    latin = F.decode(content, "ISO-8859-1")
    found = F.regexp_extract_all(latin, F.lit(r"\(((?:[^()\\]|\\.)*)\)\s*Tj"), F.lit(1))
    return F.array_join(F.transform(found, lambda s: F.regexp_replace(s, r"\\([()\\])", "$1")), " ")


def keyed_path(*steps: Column) -> Column:
    """A JSON pointer of steps, tildes and slashes escaped."""
    return F.concat(*[F.concat(F.lit("/"), F.replace(F.replace(s, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))) for s in steps])
