"""Session helpers: table access, the shared scratch folder, lineage cuts and skew-safe joins."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this measured size; beyond it the join is shuffled and salted.
BROADCAST_ROWS = 20_000


def build_session(master: str | None = None, cores: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, AQE, Arrow."""
    builder = (
        SparkSession.builder.appName("ledgerloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if cores:
        builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever they and the driver were started. Once per context."""
    context = spark.sparkContext
    if not getattr(context, "_ledgerloom_shipped", False):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="ledgerloom-code-")) / "ledgerloom.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in root.rglob("*.py"):
                z.write(source, source.relative_to(root.parent))
        context.addPyFile(str(target))
        context._ledgerloom_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a local one where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "ledgerloom-scratch")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove what the operators of this session left in the shared folder. Results still being read are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        for status in fs.listStatus(path):
            fs.delete(status.getPath(), True)


def salt_of(column: Column | str, salts: int) -> Column:
    """A salt in [0, salts) that depends on the row only, so that a retried task gives the same rows."""
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether counting shows at most `rows` rows. Meant for stored tables: what `df` computes runs for the count."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], row_id: str, how: str = "left", salts: int = 16, small: bool | None = None) -> DataFrame:
    """Join many rows, whose keys may be heavily skewed, with a lookup table that has each key once.

    The lookup is broadcast only if it was counted and is small. Beyond that the rows are salted by `row_id` and the
    lookup is repeated once per salt, so that one hot key is spread over `salts` tasks.
    """
    if is_small(lookup) if small is None else small:
        return rows.join(F.broadcast(lookup), keys, how)
    salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # the hint: the planner's estimate of a side does not know that explode makes it larger, and would broadcast it
    return rows.withColumn("_salt", salt_of(row_id, salts)).join(salted.hint("merge"), [*keys, "_salt"], how).drop("_salt")
