"""References to rows that are absent, deleted or received later, per table and period.

The distinct non-null foreign keys, pre-aggregated with the times at which they occur, meet the parents' keys in a left
anti join (absent keys) and an equi join (parents that came late or were deleted). Only keys that can fail are joined
back to the referring rows, salted, since one key may hold a third of them.

Results by case:
- keys are compared without case and outer blanks; null and blank keys refer to nothing and give no row; a compound key
  refers to nothing if any of its parts is null or blank;
- 'missing': no parent row has the key; 'late': every such row was received after the child; 'deleted': every such row
  was deleted at or before the child's receipt; a mixture of late and deleted parents is no failure;
- a null receipt of a parent is never late, one of a child never late or deleted; such a child's period is null;
- repeated child rows are each reported; empty parents make every reference missing; empty children give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import salt_of

SALTS = 16


def normal_key(column: Column | str) -> Column:
    """Lower case, outer white space removed; blank is null."""
    text = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.regexp_replace(F.lower(text.cast("string")), r"^[\s ]+|[\s ]+$", ""), F.lit(""))


def _keyed(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    out = rows.select(*[normal_key(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c.alias(n) for n, c in columns.items()])
    return out.dropna("any", subset=[f"_k{i}" for i in range(len(keys))])


def orphan_references(
    children: DataFrame,
    parents: DataFrame,
    child_keys: list[str],
    parent_keys: list[str],
    row_id: str = "row_id",
    received_at: str = "received_at",
    deleted_at: str | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """(row_id, reason, received_at) of every child row whose reference fails."""
    keys = [f"_k{i}" for i in range(len(child_keys))]
    child = _keyed(children, child_keys, {"_row": F.col(row_id), "_at": F.col(received_at)})
    gone = F.col(deleted_at) if deleted_at else F.lit(None).cast("timestamp")
    parent = _keyed(parents, parent_keys, {"_received": F.col(received_at), "_gone": gone})
    parent = parent.groupBy(*keys).agg(
        F.when(F.count("_received") == F.count(F.lit(1)), F.min("_received")).alias("_first"),
        F.when(F.count("_gone") == F.count(F.lit(1)), F.max("_gone")).alias("_gone"),
    )
    used = child.groupBy(*keys).agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    missing = used.join(parent, keys, "left_anti").select(*keys, F.lit(None).cast("timestamp").alias("_first"), F.lit(None).cast("timestamp").alias("_gone"), F.lit(True).alias("_missing"))
    doubtful = used.join(parent.where(F.col("_first").isNotNull() | F.col("_gone").isNotNull()), keys)
    doubtful = doubtful.where((F.col("_from") < F.col("_first")) | (F.col("_to") >= F.col("_gone"))).select(*keys, "_first", "_gone", F.lit(False).alias("_missing"))
    failing = missing.unionByName(doubtful).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = child.withColumn("_salt", salt_of("_row", salts)).join(failing.hint("merge"), [*keys, "_salt"])
    reason = F.when(F.col("_missing"), "missing").when(F.col("_at") < F.col("_first"), "late").when(F.col("_at") >= F.col("_gone"), "deleted")
    return joined.select(F.col("_row").alias("row_id"), reason.alias("reason"), F.col("_at").alias("received_at")).where(F.col("reason").isNotNull())


def orphan_counts(found: DataFrame) -> DataFrame:
    """Failing references per child table, reference, period and reason."""
    return found.groupBy("child_table", "ref_field", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n_rows"))
