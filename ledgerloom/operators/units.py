"""Quantities in different units and notations, converted to one common unit of each kind.

The distinct spellings of units are mapped to known units through an inverted index of character n-grams; a weighted
edit distance verifies each candidate. The resulting alias dictionary is joined back to all rows.

Results by case:
- a row's unit is what the unit field says if that names a unit, else what follows the number in the quantity, else what
  the description says of the quantity ("quantity in kg", "[pcs]", "UOM: m"); package sizes have no such words and are
  never units of the row;
- no quantity, an unreadable one, or no known unit: `common_unit` and the amounts are null, the row stays;
- a spelling that fits units of two kinds or factors equally well is unknown;
- amounts of 10^18 or more are unreadable; if thousandths of the common unit do not fit a bigint, they are null;
- amounts are exact: factors are fractions of integers, thousandths are rounded half away from zero;
- repeated rows are kept; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import is_small, lookup_join, store

# Factors to the common unit (exact by definition) and the unit codes of UN/ECE Recommendation 20.
# A quarter is 3 months, a year 12; ounces are avoirdupois, gallons US.
_UNITS: dict[str, tuple[str, str, str]] = {
    # unit: (common unit, factor, names and codes)
    "kg": ("kg", "1", "kgm kg kgs kilo kilos kilogram kilogramme kilogramm kilogramo chilogrammo"),
    "g": ("kg", "1/1000", "grm g gr gram gramme gramm gramo"),
    "mg": ("kg", "1/1000000", "mgm mg milligram milligramme milligramm"),
    "t": ("kg", "1000", "tne t to tonne tonnen tonnes metric_ton metric_tons tonelada"),
    "lb": ("kg", "45359237/100000000", "lbr lb lbs pound libra"),
    "oz": ("kg", "28349523125/1000000000000", "onz oz ounce onza unze"),
    "l": ("l", "1", "ltr l liter litre litro dmq"),
    "ml": ("l", "1/1000", "mlt ml milliliter millilitre cmq"),
    "cl": ("l", "1/100", "clt cl centiliter centilitre zentiliter"),
    "dl": ("l", "1/10", "dlt dl deciliter decilitre"),
    "hl": ("l", "100", "hlt hl hectoliter hectolitre hektoliter"),
    "m3": ("l", "1000", "mtq m3 cbm cubic_metre cubic_meter kubikmeter"),
    "gal": ("l", "3785411784/1000000000", "gll gal us_gal gal_us us_gallon gallon"),
    "m": ("m", "1", "mtr m meter metre metro lfm laufmeter"),
    "cm": ("m", "1/100", "cmt cm centimeter centimetre zentimeter"),
    "mm": ("m", "1/1000", "mmt mm millimeter millimetre"),
    "km": ("m", "1000", "kmt ktm km kilometer kilometre"),
    "in": ("m", "254/10000", "inh in inch inches zoll"),
    "ft": ("m", "3048/10000", "fot ft foot feet"),
    "yd": ("m", "9144/10000", "yrd yd yard"),
    "m2": ("m2", "1", "mtk m2 qm sqm square_metre square_meter quadratmeter"),
    "cm2": ("m2", "1/10000", "cmk cm2 square_centimetre square_centimeter quadratzentimeter"),
    "ft2": ("m2", "9290304/100000000", "ftk ft2 sqft sq_ft square_foot square_feet"),
    "h": ("h", "1", "hur h hr hrs hour heure hora stunde stunden std"),
    "min": ("h", "1/60", "min mins minute minuten minuto"),
    "s": ("h", "1/3600", "sec second sekunde"),
    "d": ("h", "24", "day"),
    "month": ("month", "1", "mon mo month mois monat monate mes meses"),
    "quarter": ("month", "3", "qan qtr quarter quartal quartale trimestre"),
    "year": ("month", "12", "ann yr year an annee annees année années jahr jahre ano"),
    "each": ("each", "1", "ea h87 c62 pc pcs pce piece pieces each unit stk stück stuck stueck pièce unité unidad pieza"),
    "pair": ("each", "2", "pr pair prs paar paire"),
    "dozen": ("each", "12", "dzn doz dozen dutzend dtzd douzaine docena"),
    "hundred": ("each", "100", "cen hundred hundert cent"),
    "gross": ("each", "144", "gro gross"),
    "thousand": ("each", "1000", "mil thousand tausend tsd mille"),
}
#: Written in place of a unit where there is none.
_FILLER = frozenset({"", "na", "zz", "none", "null", "unknown", "tbd", "xx"})


def _names() -> list[tuple[str, str]]:
    """(normalised name, unit), plurals by rule."""
    out: dict[str, str] = {}
    for unit, (_, _, names) in _UNITS.items():
        for name in names.split():
            plain = name.replace("_", "")
            out.setdefault(plain, unit)
            if len(plain) > 3 and not plain.endswith("s"):
                for plural in (plain + "s", plain + "n") if plain.isascii() else (plain + "s",):
                    out.setdefault(plural, unit)
            if "_" in name and not name.endswith("s"):
                out.setdefault(plain + "s", unit)
    return sorted(out.items())


def normal_unit(column: Column | str) -> Column:
    """Lower case, superscripts as digits, letters and digits only."""
    text = F.lower(F.col(column) if isinstance(column, str) else column)
    return F.regexp_replace(F.translate(text, "²³", "23"), r"[^\p{L}\p{N}]+", "")


#: Costs of the weighted edit distance: slips that typing and inflection make often are cheap.
_CHEAP_PAIRS = frozenset(map(frozenset, ("ei", "ea", "er", "kc", "sz", "yi", "uü", "oö", "aä", "eé", "eè", "nm", "0o", "1l", "1i")))
MAX_COST_PER_LETTER = 0.2
_PAD = "^"


def weighted_distance(a: str, b: str) -> float:
    """Edit distance with transpositions; doubled letters cost half, likely confusions 0.4, the first letter 1.5."""
    before: list[float] | None = None
    row = [0.0]
    for j in range(len(b)):
        row.append(row[-1] + (0.5 if j and b[j] == b[j - 1] else 1.0))
    for i, x in enumerate(a):
        new = [row[0] + (0.5 if i and x == a[i - 1] else 1.0)]
        for j, y in enumerate(b):
            change = 0.0 if x == y else 0.4 if frozenset((x, y)) in _CHEAP_PAIRS else 1.0
            if change and i == j == 0:
                change = 1.5
            best = min(row[j] + change, row[j + 1] + (0.5 if i and x == a[i - 1] else 1.0), new[j] + (0.5 if j and y == b[j - 1] else 1.0))
            if before is not None and i and j and x == b[j - 1] and a[i - 1] == y and x != y:
                best = min(best, before[j - 1] + 0.8)
            new.append(best)
        before, row = row, new
    return row[-1]


@F.pandas_udf(T.DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _grams(name: Column) -> Column:
    padded = F.concat(F.lit(_PAD), name, F.lit(_PAD))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, 2)))


def alias_dictionary(spellings: DataFrame, spelling: str = "spelling", max_cost: float = MAX_COST_PER_LETTER) -> DataFrame:
    """Map distinct spellings to units: (spelling, unit, common_unit, num, den, cost). Unknown spellings are left out.

    Spellings and names meet in an inverted index of character bigrams. A candidate must share at least half of its
    bigrams with a name, or all but one; names of up to three letters must be equal, longer ones within `max_cost` per
    letter. The cheapest name wins; if names of different units are equally cheap, the spelling is unknown.
    """
    spark = spellings.sparkSession
    # each letter more costs at least half, so longer spellings are beyond `max_cost` of every name
    longest = int(max(len(n) for n, _ in _names()) * (1 + 2 * max_cost)) + 1
    names = spark.createDataFrame(_names(), "name string, unit string").withColumn("gram", F.explode(_grams(F.col("name"))))
    names = names.withColumn("n_name", F.size(_grams(F.col("name"))))
    written = spellings.select(F.col(spelling).alias("spelling"), normal_unit(spelling).alias("plain")).where(F.length("plain").between(1, longest) & ~F.col("plain").isin(*_FILLER))
    plain = written.select("plain").distinct().withColumn("gram", F.explode(_grams(F.col("plain")))).withColumn("n_plain", F.size(_grams(F.col("plain"))))
    # the index of the fixed list of names has a few hundred postings, whatever the data
    met = plain.join(F.broadcast(names), "gram").groupBy("plain", "name", "unit").agg(F.count("*").alias("shared"), F.first("n_plain").alias("n_plain"), F.first("n_name").alias("n_name"))
    met = met.where((F.col("shared") * 2 >= F.greatest("n_plain", "n_name")) | (F.col("shared") + 1 >= F.least("n_plain", "n_name")))
    long = (F.length("plain") > 3) & (F.length("name") > 3)
    met = met.where(long | (F.col("plain") == F.col("name"))).withColumn("cost", F.when(F.col("plain") == F.col("name"), F.lit(0.0)).otherwise(_distance("plain", "name")))
    met = met.where(F.col("cost") <= max_cost * F.least(F.length("plain"), F.length("name")))
    by_unit = met.groupBy("plain", "unit").agg(F.min("cost").alias("cost"))
    best = by_unit.groupBy("plain").agg(F.min(F.struct("cost", "unit")).alias("b"), F.array_sort(F.collect_list("cost")).alias("costs"))
    best = best.where((F.size("costs") == 1) | (F.try_element_at("costs", F.lit(2)) > F.col("b.cost"))).select("plain", "b.unit", "b.cost")
    facts = [(u, common, Fraction(f).numerator, Fraction(f).denominator) for u, (common, f, _) in _UNITS.items()]
    known = spark.createDataFrame(facts, "unit string, common_unit string, num long, den long")
    return written.join(best.join(F.broadcast(known), "unit"), "plain").select("spelling", "unit", "common_unit", "num", "den", "cost")


#: What introduces the unit of the quantity in a description, and the unit itself.
_CUE = r"(?i)(\[|\bUOM\b|unit of measure|\bbilled\b|\bquanti|\bqty\b|\bqté|\bmenge\b|\bcantidad\b)"
_SAYS = (
    r"(?i)(?:\[\s*(?=[^\]\d])([^\]]+?)\s*\]\s*$"
    r"|(?:\bUOM\s*:|\bunit of measure\s*:?|\bbilled (?:by|in|per)(?:\s+the)?)\s+(.+?)\s*$"
    r"|\b(?:quantity|qty|menge|quantité|qté|cantidad)\s+(?:given\s+)?(?:in|en)\s+([^:()]+(?:\(US\))?)\s*(?:\)\s*$|:|$))"
)
#: Thousandths of the common unit from here on do not fit a bigint; such rows have `common_quantity` only.
MAX_MILLI = 9.2e18
_NUMBER = r"^\s*([-+−]?\s*\d[\d.,'’\s]*)"
_PLAIN = r"^-?\d+(\.\d+)?$"


def quantity_number(quantity: Column) -> Column:
    """The number of a quantity as plain decimal text, or null. Most are plain already and cost one test."""
    raw = F.regexp_extract(quantity, _NUMBER, 1)
    digits = F.regexp_replace(F.regexp_replace(raw, r"[\s'’]", ""), "−", "-")
    digits = F.regexp_replace(digits, r"^(.*[^.,])[.,]$", "$1")
    # a comma before one or two final digits is the decimal mark; other commas group digits
    comma = digits.rlike(r",\d{1,2}$")
    number = F.when(comma, F.regexp_replace(F.regexp_replace(F.regexp_replace(digits, r",(\d{1,2})$", "#$1"), r"[.,]", ""), "#", "."))
    number = number.otherwise(F.regexp_replace(digits, ",", ""))
    return F.when(quantity.rlike(_PLAIN), quantity).otherwise(F.when(number.rlike(r"^[-+]?\d+(\.\d+)?$"), number))


def quantity_tail(quantity: Column) -> Column:
    """What follows the number; null for plain numbers."""
    return F.when(~quantity.rlike(_PLAIN), F.nullif(F.trim(F.substring(quantity, F.length(F.regexp_extract(quantity, _NUMBER, 0)) + 1, F.length(quantity))), F.lit("")))


def description_unit(description: Column) -> Column:
    """The unit that a description states for the quantity, or null."""
    parts = [F.nullif(F.trim(F.regexp_extract(description, _SAYS, i)), F.lit("")) for i in range(1, 4)]
    return F.when(description.rlike(_CUE), F.coalesce(*parts))


def normalise_quantities(
    rows: DataFrame, row_id: str = "row_id", quantity: str = "quantity", unit: str = "unit_code", description: str = "description", price: str = "unit_price", price_base: str = "price_base_quantity"
) -> DataFrame:
    """Every row with its quantity in the common unit and its price per one common unit.

    Columns: row_id, unit_source (unit, quantity, description), spelling, unit, common_unit, amount (as written),
    quantity_milli (thousandths of the common unit, rounded), common_quantity and price_per_common_unit (double).
    """
    base = rows.select(
        F.col(row_id).alias("row_id"),
        F.col(quantity).alias("_quantity"),
        F.col(description).alias("_description"),
        F.nullif(F.trim(F.col(unit)), F.lit("")).alias("_s0"),
        F.expr(f"try_cast(`{price}` as double)").alias("_price"),
        F.expr(f"try_cast(`{price_base}` as double)").alias("_base"),
    )

    def dictionary(spellings: DataFrame, label: str) -> tuple[DataFrame, bool]:
        out = store(alias_dictionary(store(spellings.where("spelling is not null").distinct(), f"{label}-spellings")), f"{label}-aliases")
        return out, is_small(out)

    def looked_up(df: DataFrame, aliases: tuple[DataFrame, bool], i: int) -> DataFrame:
        entry = aliases[0].select(F.col("spelling").alias(f"_s{i}"), F.struct("unit", "common_unit", "num", "den").alias(f"_e{i}"))
        return lookup_join(df, entry, [f"_s{i}"], "row_id", small=aliases[1])

    # texts are searched for units only in rows whose unit field names none
    out = looked_up(base, dictionary(base.select(F.col("_s0").alias("spelling")), "unit"), 0)
    tail = F.when(F.col("_e0").isNull(), quantity_tail(F.col("_quantity")))
    said = F.when(F.col("_e0").isNull(), description_unit(F.col("_description")))
    texts = dictionary(out.where("_e0 is null").select(F.explode(F.array(tail, said)).alias("spelling")), "text")
    out = looked_up(out.withColumn("_s1", tail), texts, 1)
    out = looked_up(out.withColumn("_s2", F.when(F.col("_e1").isNull(), said)), texts, 2)
    sources = ("unit", "quantity", "description")
    first = F.coalesce(*[F.when(F.col(f"_e{i}").isNotNull(), F.struct(F.lit(s).alias("source"), F.col(f"_s{i}").alias("spelling"), F.col(f"_e{i}").alias("e"))) for i, s in enumerate(sources)])
    out = out.withColumn("_hit", first).withColumn("_amount", quantity_number(F.col("_quantity")).try_cast("decimal(24,6)"))
    known = F.col("_hit").isNotNull() & F.col("_amount").isNotNull()
    # exact: |amount| in millionths * 1000 * num / (den * 10^6), half away from zero
    scaled = "cast(abs(_amount) * 1000000 as decimal(27, 0))"
    milli = f"cast(sign(_amount) as bigint) * ((cast(2 * {scaled} * _hit.e.num as decimal(38, 0)) + cast(1000 as decimal(10, 0)) * _hit.e.den) div (cast(2000 as decimal(10, 0)) * _hit.e.den))"
    factor = F.col("_hit.e.num") / F.col("_hit.e.den")
    return out.select(
        "row_id",
        F.col("_hit.source").alias("unit_source"),
        F.col("_hit.spelling").alias("spelling"),
        F.col("_hit.e.unit").alias("unit"),
        F.when(known, F.col("_hit.e.common_unit")).alias("common_unit"),
        F.col("_amount").alias("amount"),
        F.when(known & (F.abs(F.col("_amount").cast("double") * factor) * 1000 < MAX_MILLI), F.expr(milli)).alias("quantity_milli"),
        F.when(known, F.col("_amount").cast("double") * factor).alias("common_quantity"),
        F.when(known & F.col("_price").isNotNull(), F.col("_price") / F.when(F.col("_base") != 0, F.col("_base")).otherwise(F.when(F.col("_base").isNull(), F.lit(1.0))) / factor).alias("price_per_common_unit"),
        (F.col("_hit.e.num") == F.col("_hit.e.den")).alias("is_common"),
    )
