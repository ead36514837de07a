"""Structured Streaming over event files: windows with watermarks, deduplication, idempotent upserts, keyed state.

Sources are Parquet files, sinks tables in the shared folder; a query runs until it has read what is there
(`availableNow`), so that the same code serves tests, catch-up runs and, with another trigger, a standing job.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.history import latest
from ledgerloom.session import scratch_path

WATERMARK = "1 hour"


def source(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """A stream over the Parquet files at a path, which may be one file or a folder."""
    schema = spark.read.parquet(path).schema
    local = path.removeprefix("file://")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if os.path.isfile(local):
        stream = reader.option("pathGlobFilter", os.path.basename(local)).parquet(os.path.dirname(local))
    else:
        stream = reader.parquet(path)
    # event times need a time zone: those without are in UTC
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, mode: str, state: str) -> int:
    """Run to the end of what is there; every micro-batch replaces its own folder of `state`, so one that runs again after a
    failure changes nothing. The checkpoint lies in `state` too: the next run goes on where this one ended. Returns the
    number of rows that came after the watermark and were left out."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/out/batch={number}")

    job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{state}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    job.awaitTermination()
    return sum(o["numRowsDroppedByWatermark"] for p in job.recentProgress for o in p["stateOperators"])


def _written(spark: SparkSession, state: str, schema: T.StructType) -> DataFrame:
    """Everything that batches wrote, with the number of the batch."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/out")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(full).parquet(f"{state}/out") if there else spark.createDataFrame([], full)


def windowed(spark: SparkSession, path: str, width: str = "1 hour", state: str | None = None, late: str = WATERMARK) -> DataFrame:
    """Counts and sums per window and type. Each batch writes the windows that it changed; the last state of each counts.

    With a fixed `state` folder a later run takes up new files only. How many rows came after the watermark and were
    left out is in `windowed.late`.
    """
    state = state or scratch_path(spark, "windows")
    events = source(spark, path).withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    flat = grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "cents")
    windowed.late = _run(flat, "update", state)
    keys = ["window_start", "event_type"]
    return latest(_written(spark, state, flat.schema), keys, ["batch"]).drop("batch")


def deduplicated(spark: SparkSession, path: str, key: str = "event_id", state: str | None = None) -> DataFrame:
    """Every event once: repeats within the watermark are dropped by state before they are written, others when it is read."""
    state = state or scratch_path(spark, "events")
    events = source(spark, path).withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark([key])
    deduplicated.late = _run(events, "append", state)
    return _written(spark, state, events.schema).drop("batch").dropDuplicates([key])


def spend_state(events: DataFrame, limit: int) -> DataFrame:
    """(user_id, accepted, rejected, spent) per key and batch: the breaker opens at the first breach and stays open."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, is_open = state.get if state.exists else (0, False)
        accepted = rejected = 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for cents in rows["cents"]:
            is_open = is_open or spent + int(cents) > limit
            if is_open:
                rejected += 1
            else:
                spent, accepted = spent + int(cents), accepted + 1
        state.update((spent, is_open))
        yield pd.DataFrame([(key[0], accepted, rejected, spent)], columns=["user_id", "accepted", "rejected", "spent"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, accepted long, rejected long, spent long", "spent long, open boolean", "update", GroupStateTimeout.NoTimeout)
