"""Exact money: guarded parsing of decimal text, canonical text, scale and minor units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Twenty digits and eight decimals: sums of such values stay exact in 38 digits.
PATTERN = r"^-?\d{1,20}(\.\d{1,8})?$"
TYPE = "decimal(28,8)"
# Decimals of the currencies that the arithmetic rules know; others are not checked.
MINOR_UNITS = {"BHD": 3, "EUR": 2, "GBP": 2, "INR": 2, "IQD": 3, "JOD": 3, "JPY": 0, "KWD": 3, "LYD": 3, "OMR": 3, "TND": 3, "USD": 2}


def parse(text: Column) -> Column:
    """DECIMAL(28, 8), or null for text that is not plain decimal notation (exponents, blanks, too many digits)."""
    return F.when(text.rlike(PATTERN), text.try_cast(TYPE))


def or_zero(text: Column) -> Column:
    return F.coalesce(parse(text), F.lit(0).cast(TYPE))


def text(value: Column) -> Column:
    """Shortest notation: no trailing zeros, no exponent, no negative zero."""
    shown = value.cast("string")
    short = F.when(shown.contains("."), F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", "")).otherwise(shown)
    return F.when(short == "-0", "0").otherwise(short)


def scale(amount: Column) -> Column:
    """Decimals in use, trailing zeros aside; null if it is no decimal."""
    return F.when(amount.rlike(PATTERN), F.length(F.regexp_extract(F.regexp_replace(amount, r"(\.\d*?)0+$", "$1"), r"\.(\d+)$", 1)))


def minor_units(currency: Column) -> Column:
    pairs = [x for c, n in MINOR_UNITS.items() for x in (F.lit(c), F.lit(n))]
    return F.try_element_at(F.create_map(*pairs), F.upper(F.trim(currency)))


def tolerance(currency: Column) -> Column:
    """One minor unit; null for unknown currencies, so that rules built on it do not apply."""
    units = minor_units(currency)
    return F.when(units == 0, F.lit("1")).when(units == 2, F.lit("0.01")).when(units == 3, F.lit("0.001")).cast(TYPE)
