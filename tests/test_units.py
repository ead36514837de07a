from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.units import _UNITS, _names, alias_dictionary, normalise_quantities, weighted_distance

SCHEMA = "row_id long, quantity string, unit_code string, description string, unit_price string, price_base_quantity string, unit string"


def run(spark, *rows):
    df = spark.createDataFrame([(i, *r, "10", "1", "clash") for i, r in enumerate(rows)], SCHEMA)
    return {r.row_id: r for r in normalise_quantities(df).collect()}


def test_every_name_maps_to_its_own_unit(spark):
    names = _names()
    got = {r.spelling: (r.unit, r.cost) for r in alias_dictionary(spark.createDataFrame([(n,) for n, _ in names], "spelling string")).collect()}
    assert got == {n: (u, 0.0) for n, u in names}


@pytest.mark.parametrize("typed, unit", [("Kilogram", "kg"), ("kilogrmas", "kg"), ("metrs", "m"), ("Stükc", "each"), ("SQ. FT", "ft2"), ("Monat", "month"), ("m²", "m2"), ("douzzaines", "dozen")])
def test_spellings(spark, typed, unit):
    assert [r.unit for r in alias_dictionary(spark.createDataFrame([(typed,)], "spelling string")).collect()] == [unit]


def test_unknown_and_filler_spellings_stay_unknown(spark):
    rows = [("sack",), ("?",), ("-",), ("N/A",), ("ZZ",), ("",), (None,), ("drum of nine litres, large",), ("x" * 5000,), ("kx",)]
    assert alias_dictionary(spark.createDataFrame(rows, "spelling string")).count() == 0


def test_sources_in_order_and_package_sizes(spark):
    out = run(spark, ("5", "LBR", "x [kg]"), ("5 kg", "?", "x [lb]"), ("5", None, "Rope, quantity in ft"), ("5", "ZZ", "Oil, drum of 60 l"), ("5", None, "Oil 500 ml bottle"), (None, "KGM", "x"), ("abc", "KGM", "x"), ("5", "-", None))
    assert [(out[i].unit_source, out[i].common_unit, out[i].quantity_milli) for i in range(8)] == [
        ("unit", "kg", 2268), ("quantity", "kg", 5000), ("description", "m", 1524), (None, None, None), (None, None, None), ("unit", None, None), ("unit", None, None), (None, None, None)
    ]


@pytest.mark.parametrize("text, milli", [("1,5", 1500), ("1,25", 1250), ("1,234", 1234000), ("1,234.5", 1234500), ("1 234", 1234000), ("1'234", 1234000), ("-0.0005", -1), ("0.0004", 0), ("1.234,5", 1234500), ("2.300", 2300)])
def test_number_notations(spark, text, milli):
    assert run(spark, (text, "KGM", None))[0].quantity_milli == milli


def test_rounding_is_exact_and_half_away(spark):
    out = run(spark, ("0.03", "MIN", None), ("-0.03", "MIN", None), ("1", "ONZ", None), ("3", "GRO", None), ("999999999999", "TNE", None), ("1" * 30, "KGM", None))
    assert [out[i].quantity_milli for i in range(6)] == [1, -1, 28, 432000, 999999999999000000, None]
    assert out[2].price_per_common_unit == pytest.approx(10 / 0.028349523125)


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "2", "DZN", None, None, None, "c")] * 3, SCHEMA)
    assert [r.quantity_milli for r in normalise_quantities(df).collect()] == [24000] * 3
    assert normalise_quantities(df.where("false")).count() == 0


def test_distance_is_a_weighted_edit_distance():
    assert weighted_distance("kilogram", "kilogram") == 0 and weighted_distance("meter", "metre") < 1.7
    assert weighted_distance("abc", "xbc") == 1.5 and weighted_distance("gramm", "gram") == 0.5


def test_p2_against_decimals(spark, sf):
    from fractions import Fraction

    from ledgerloom.session import read_table

    lines = read_table(spark, sf, "line_items")
    known = {n: u for n, u in _names()}
    rows = normalise_quantities(lines).join(lines.select("row_id", "quantity", "unit_code"), "row_id").where(F.col("quantity").rlike(r"^-?\d+(\.\d+)?$")).collect()
    checked = 0
    for r in rows:
        unit = known.get("".join(c for c in (r.unit_code or "").lower().replace("²", "2").replace("³", "3") if c.isalnum()))
        if unit:
            exact = Fraction(Decimal(r.quantity)) * Fraction(_UNITS[unit][1]) * 1000
            want = int(abs(exact) + Fraction(1, 2)) * (1 if exact >= 0 else -1)
            assert (r.common_unit, r.quantity_milli) == (_UNITS[unit][0], want)
            checked += 1
    assert checked > 200
