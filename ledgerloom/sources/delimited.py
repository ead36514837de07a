"""CSV and configuration readers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file or folder with a header, every column as text; quotes are doubled and fields may span lines.

    With `columns` the file need not be read for its header; a row that lacks fields has nulls, a blank field is null.
    """
    reader = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true")
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(path)


def read_config(spark: SparkSession, path: str) -> dict:
    """A small JSON configuration, wherever Spark can read it."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
