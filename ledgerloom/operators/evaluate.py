"""Expected against observed fields: comparison modes, rollups and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import decimals as D
from ledgerloom.functions import texts as X


def outcome(expected: Column, observed: Column, mode: str, null_equals_null: bool = False) -> Column:
    """matched, mismatch or field_missing. Two nulls match only where asked; a missing field is never a match."""
    if mode == "decimal":
        same = D.parse(expected) == D.parse(observed)
    elif mode == "normalized":
        same = X.scalar(expected) == X.scalar(observed)
    else:
        same = expected == observed
    both = F.when(F.lit(null_equals_null) & expected.isNull() & observed.isNull(), "matched")
    return both.when(expected.isNull() | observed.isNull(), "field_missing").when(F.coalesce(same, F.lit(False)), "matched").otherwise("mismatch")


def accuracy(compared: DataFrame, *by: str) -> DataFrame:
    """Overall, by the first and by both keys: cases, fields, matches, accuracy as text of six decimals."""
    out = compared.rollup(*by).agg(F.countDistinct("case_id").alias("n_cases"), F.count(F.lit(1)).alias("n_fields"), F.count(F.when(F.col("outcome") == "matched", 1)).alias("n_matched"))
    return out.withColumn("accuracy", F.format_string("%.6f", F.col("n_matched") / F.col("n_fields")))


BINS = 4096


def percentiles(rows: DataFrame, by: str, value: str, *points: float) -> DataFrame:
    """(by, p50, ...): the smallest value with at least that share of the group's values at or below it. Nulls do not count.

    Counted in bins first, which are few; then only the bins that hold a percentile are looked into, value by value, so no
    task sees a whole group. All values of a bin equal or not, they are pre-aggregated.
    """
    v = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    span = v.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    counted = v.groupBy("g", "v").agg(F.count(F.lit(1)).alias("k"))
    binned = counted.join(span.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).otherwise(F.lit(0)))
    binned = binned.select("g", "v", "k", "n", "bin")
    bins = binned.groupBy("g", "n", "bin").agg(F.sum("k").alias("k"))
    below = F.sum("k").over(Window.partitionBy("g").orderBy("bin")) - F.col("k")
    wanted = F.explode(F.array(*[F.struct(F.lit(f"p{round(100 * p)}").alias("name"), F.ceil(F.col("n") * p).alias("rank")) for p in points])).alias("w")
    hit = bins.withColumn("below", below).select("g", "bin", "below", "k", wanted).where("w.rank > below and w.rank <= below + k").select(F.col("g").alias("h"), F.col("bin").alias("b"), "below", "w.name", "w.rank")
    inside = binned.join(hit, F.col("g").eqNullSafe(F.col("h")) & (F.col("bin") == F.col("b")))
    upto = F.col("below") + F.sum("k").over(Window.partitionBy("g", "name").orderBy("v"))
    found = inside.withColumn("upto", upto).where("upto >= rank").groupBy("g", "name").agg(F.min("v").alias("v"))
    return found.groupBy(F.col("g").alias(by)).agg(*[F.min(F.when(F.col("name") == f"p{round(100 * p)}", F.col("v"))).alias(f"p{round(100 * p)}") for p in points])
