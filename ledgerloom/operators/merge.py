"""Idempotent delivery without a transactional table format: the new snapshot is computed, then swapped in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.history import latest


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Target rows whose key does not come in, and the last incoming row of each key. Null keys are never matched."""
    new = incoming.select(*target.columns)
    if order:
        new = latest(incoming, keys, order).select(*target.columns)
    return target.join(new.select(*keys), keys, "left_anti").select(*target.columns).unionByName(new)


def replace_children(target: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All children of the incoming parents are replaced by the incoming children; parents without any lose theirs only
    if they come in."""
    kept = target.join(incoming.select(parent).distinct(), parent, "left_anti")
    return kept.select(*target.columns).unionByName(incoming.select(*target.columns))


def upsert_counts(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """(inserted, updated, kept) in one pass over both key sets."""
    t = target.select(*keys).distinct().withColumn("_t", F.lit(1))
    i = incoming.select(*keys).distinct().withColumn("_i", F.lit(1))
    both = t.join(i, keys, "full_outer")
    return both.agg(
        F.count(F.when(F.col("_t").isNull(), 1)).alias("inserted"), F.count(F.when(F.col("_t").isNotNull() & F.col("_i").isNotNull(), 1)).alias("updated"), F.count(F.when(F.col("_i").isNull(), 1)).alias("kept")
    )
