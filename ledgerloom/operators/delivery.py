"""Delivery to an external schema: snapshots of schemas, rows transformed by a mapping, outcomes and status of a push.

Results by case: a mapping without columns gives rows of keys only; a value that cannot be coerced is null and its issue is
listed; a row with any issue fails alone; a push without rows is pushed; a retry takes the rows that failed and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.coerce import coerced


def schema_snapshot(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table_name, columns: array of (position, name, data_type)) of tables by path: a few rows per table, from the footers."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, p in paths.items() for i, f in enumerate(spark.read.parquet(p).schema.fields, 1)]
    flat = spark.createDataFrame(rows, "table_name string, position int, name string, data_type string")
    return flat.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("position", "name", "data_type"))).alias("columns"))


def key_columns(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """Constraints and the columns they use, joined on name, schema and table, numbered within each."""
    return constraints.join(usage, ["constraint_name", "table_schema", "table_name"])


def transformed(rows: DataFrame, key: str, mapping: list[tuple[str, str, str, str, bool]]) -> DataFrame:
    """(key, one column per target, issues) by a mapping of (source, target, kind, bucket, nullable): renamed and coerced."""
    out = rows.select(key, *[coerced(F.col(s), kind, to, nullable).alias(t) for s, t, kind, to, nullable in mapping])
    issues = [F.when(F.col(f"{t}.issue").isNotNull(), F.concat(F.lit(f"{t}:"), F.col(f"{t}.issue"))) for _, t, *_ in mapping]
    return out.select(key, *[F.col(f"{t}.value").alias(t) for _, t, *_ in mapping], (F.array_compact(F.array(*issues)) if issues else F.array().cast("array<string>")).alias("issues"))


def push_outcomes(header: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """The header rows with their status: pushed if neither the header nor any line of its key has an issue, else failed whole."""
    bad = lines.where(F.size("issues") > 0).groupBy(key).agg(F.count(F.lit(1)).alias("bad_lines"))
    joined = header.join(bad, key, "left")
    issues = F.concat("issues", F.when(F.col("bad_lines").isNotNull(), F.array(F.concat(F.lit("lines:"), F.col("bad_lines")))).otherwise(F.array().cast("array<string>")))
    return joined.select(*[c for c in header.columns if c != "issues"], issues.alias("issues")).withColumn("status", F.when(F.size("issues") == 0, "pushed").otherwise("failed"))


def push_status(outcomes: DataFrame, *by: str) -> DataFrame:
    """(by, n_pushed, n_failed, status): pushed if all are, failed if none is, else partial."""
    out = outcomes.groupBy(*by).agg(F.count_if(F.col("status") == "pushed").alias("n_pushed"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    return out.withColumn("status", F.when(F.col("n_failed") == 0, "pushed").when(F.col("n_pushed") == 0, "failed").otherwise("partial"))


def to_retry(rows: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    return rows.join(outcomes.where("status = 'failed'").select(key), key, "left_semi")


def allowed(value: Column, permitted: Column) -> Column:
    """Membership in a list that permits all if it is empty or null."""
    return F.coalesce(F.size(permitted) <= 0, F.lit(True)) | F.array_contains(permitted, value)
