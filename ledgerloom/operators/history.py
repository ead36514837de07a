"""Order within groups: ordinals, latest rows, first-seen duplicates, running limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "revision") -> DataFrame:
    """Ordinals 1, 2, ... within a group; the group is sorted on disk where it does not fit in memory."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group by `order`: an aggregate with partial results, so a hot group needs no sort."""
    others = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.max(F.struct(*order, *[c for c in others if c not in order])).alias("_m"))
    return best.select(*by, *[F.col(f"_m.{c}").alias(c) for c in others])


def first_seen(rows: DataFrame, content: str, order: str) -> DataFrame:
    """Adds `first` (the smallest `order` with the same content) by a join with a pre-aggregated table."""
    firsts = rows.groupBy(content).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    return rows.join(firsts, content)


def within_limit(events: DataFrame, by: str, order: list[str], amount: str, limit: int) -> DataFrame:
    """Adds `running` and `accepted`. Amounts are not negative, and the breaker stays open once a sum exceeds the limit:
    so an event is accepted exactly if the sum of all events up to it is within the limit."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("running", F.sum(amount).over(w)).withColumn("accepted", F.col("running") <= limit)
