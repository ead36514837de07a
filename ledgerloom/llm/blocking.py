"""Pairs within blocks, without a task that sees a whole hot block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import lookup_join, store

#: Members of one block that meet in one task. Larger blocks are cut into chunks of about this size.
CHUNK = 256


def block_pairs(members: DataFrame, chunk: int = CHUNK, distinct: bool = True, carry: tuple[str, ...] = (), keep: Column | None = None) -> DataFrame:
    """(a, b), a < b, of all ids that share a block. `members` has block and id, each pair of them once.

    A block of n > chunk members is cut into c = ceil(n / chunk) chunks by a hash of the id; each pair of chunks is a
    join key of its own, so every task joins at most about 2 * chunk members of a block and no pair is dropped. Without
    `distinct`, a pair comes once for each block that it shares. `keep` is a test of a pair by the columns `carry`, which it
    finds with _a and _b behind their names; what fails it is not shuffled further.
    """
    members = members.select("block", "id", *carry).dropna(subset=["block", "id"])
    hot = store(members.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("block", F.ceil(F.col("n") / chunk).cast("int").alias("c")), "hot-blocks")
    side = lambda s: [F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in carry]]
    if hot.isEmpty():
        left, right, keys = members.select("block", *side("a")), members.select("block", *side("b")), ["block"]
    else:
        sized = lookup_join(members, hot, ["block"], "id").withColumn("c", F.coalesce("c", F.lit(1)))
        sized = sized.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("c")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("c") - 1))
        left = sized.select("block", *side("a"), F.col("mine").alias("i"), other.alias("j"))
        right = sized.select("block", *side("b"), F.col("mine").alias("j"), other.alias("i"))
        keys = ["block", "i", "j"]
    # the planner takes a side that explode or Python makes large for a small one; without the hint it broadcasts it
    pairs = left.join(right.hint("merge"), keys).where("a < b")
    pairs = (pairs if keep is None else pairs.where(keep)).select("a", "b")
    return pairs.distinct() if distinct else pairs


def crossed_pairs(left: DataFrame, right: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b) of all left and right ids that share a block; both tables have block and id, each pair of them once.

    Blocks with more than `chunk` members on a side are cut by hashes of the ids on both sides, as in `block_pairs`.
    """
    left, right = left.select("block", "id").dropna(), right.select("block", "id").dropna()
    counts = left.groupBy("block").agg(F.count(F.lit(1)).alias("n")).unionByName(right.groupBy("block").agg(F.count(F.lit(1)).alias("n")))
    hot = store(counts.groupBy("block").agg(F.max("n").alias("n")).where(F.col("n") > chunk).select("block", F.ceil(F.col("n") / chunk).cast("int").alias("c")), "hot-blocks")
    if hot.isEmpty():
        return left.withColumnRenamed("id", "a").join(right.withColumnRenamed("id", "b").hint("merge"), "block").select("a", "b")

    def cut(df: DataFrame, name: str, mine: str, other: str) -> DataFrame:
        sized = lookup_join(df, hot, ["block"], "id").withColumn("c", F.coalesce("c", F.lit(1)))
        return sized.select("block", F.col("id").alias(name), F.pmod(F.xxhash64("id"), F.col("c")).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias(other))

    return cut(left, "a", "i", "j").join(cut(right, "b", "j", "i").hint("merge"), ["block", "i", "j"]).select("a", "b")
