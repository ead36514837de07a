"""Typed coercion of text onto a target column: a value or the code of why there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import decimals as D
from ledgerloom.functions import texts as X

# Kinds of source columns and buckets of target types.
BUCKETS = {"numeric": ("int", "integer", "bigint", "decimal", "numeric", "double", "float", "real", "smallint"), "date": ("date", "timestamp"), "text": ("text", "varchar", "char", "string", "uuid", "json")}


def bucket(data_type: Column) -> Column:
    plain = F.regexp_replace(F.lower(data_type), r"[ (].*$", "")
    out = F.lit(None).cast("string")
    for name, types in BUCKETS.items():
        out = F.when(plain.isin(*types), name).otherwise(out)
    return out


def coerced(raw: Column, kind: str, to: str, nullable: bool = True) -> Column:
    """struct(value, issue): text into text, decimals and integers into numbers or text, ISO dates into dates or text."""
    none = F.lit(None).cast("string")
    missing = X.blank(raw)
    if kind == "text":
        value, good = (raw, F.lit(True)) if to == "text" else (none, F.lit(False))
    elif kind in ("decimal", "integer"):
        number = D.parse(raw)
        whole = number == F.floor(number)
        good = number.isNotNull() & (whole if kind == "integer" else F.lit(True)) & F.lit(to in ("numeric", "text"))
        value = D.text(number)
    else:
        date = X.iso_date(raw)
        good, value = date.isNotNull() & F.lit(to in ("date", "text")), date.cast("string")
    issue = F.when(missing, none if nullable else F.lit("required_value_missing")).when(~F.coalesce(good, F.lit(False)), F.lit(f"not_{kind}" if to != "text" or kind != "text" else "not_text"))
    return F.struct(F.when(~missing & F.coalesce(good, F.lit(False)), value).alias("value"), issue.alias("issue"))
