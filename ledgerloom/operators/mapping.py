"""Source columns onto the columns of an external schema: proposal by names and synonyms, validation, table choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import texts as X
from ledgerloom.operators.coerce import bucket


def propose(source: DataFrame, target: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(target_table, source_column, target_column, priority).

    `source` (source_pos, source_column, kind), `target` (target_table, target_column, ...), `synonyms` (source_column,
    priority, synonym). A source's first choice is its own name, then its synonyms in order; a target that an earlier
    source chose is taken, and the later source gets none.
    """
    wanted = source.select("source_pos", "source_column", F.lit(0).alias("priority"), X.key(F.col("source_column")).alias("name"))
    wanted = wanted.unionByName(source.join(synonyms, "source_column").select("source_pos", "source_column", "priority", X.key(F.col("synonym")).alias("name")))
    there = target.select("target_table", "target_column", X.key(F.col("target_column")).alias("name"))
    met = wanted.join(there, "name")
    first = Window.partitionBy("target_table", "source_column").orderBy("priority", "target_column")
    taken = Window.partitionBy("target_table", "target_column").orderBy("source_pos")
    chosen = met.withColumn("_c", F.row_number().over(first)).where("_c = 1").withColumn("_t", F.row_number().over(taken)).where("_t = 1")
    return chosen.select("target_table", "source_column", "target_column", "priority")


def pick_table(proposal: DataFrame, hints: list[str]) -> DataFrame:
    """The table with most matches; a name that contains a hint counts ten more; ties go to the smaller name."""
    hinted = F.lit(False)
    for h in hints:
        hinted = hinted | F.lower("target_table").contains(h)
    scored = proposal.groupBy("target_table").agg(F.count(F.lit(1)).alias("n")).withColumn("score", F.col("n") + F.when(hinted, 10).otherwise(0))
    return scored.agg(F.min(F.struct((-F.col("score")).alias("s"), "target_table", "score")).alias("b")).select("b.target_table", "b.score")


def validate(mapping: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(issue, severity, name): unknown sources, duplicate or missing targets, types that do not fit, required columns unmapped."""
    m = mapping.select("source_column", "target_column")
    issue = lambda df, code, name, severity="error": df.select(F.lit(code).alias("issue"), F.lit(severity).alias("severity"), F.col(name).alias("name"))
    typed = m.join(source, "source_column").join(target, "target_column").withColumn("bucket", bucket(F.col("data_type")))
    fits = F.when(F.col("kind") == "text", F.col("bucket") == "text").when(F.col("kind") == "date", F.col("bucket").isin("date", "text")).otherwise(F.col("bucket").isin("numeric", "text"))
    found = [
        issue(m.join(source, "source_column", "left_anti"), "unknown_source_column", "source_column"),
        issue(m.groupBy("target_column").count().where("count > 1"), "duplicate_target_column", "target_column"),
        issue(m.join(target, "target_column", "left_anti"), "missing_target_column", "target_column"),
        issue(typed.where(F.col("bucket").isNotNull() & ~fits), "type_mismatch", "source_column"),
        issue(typed.where(F.col("bucket").isNull()), "unknown_target_type", "target_column", "warning"),
        issue(source.where("required").join(m, "source_column", "left_anti"), "unmapped_required_source", "source_column"),
        issue(target.where("not nullable and not has_default").join(m, "target_column", "left_anti"), "unmapped_required_target", "target_column"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()
