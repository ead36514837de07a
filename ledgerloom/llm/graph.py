"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import store


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of every node that has an edge; `component` is the smallest node of the component.

    `edges` has the columns a and b of one orderable type. Each round is two aggregations over the edges (a star's
    centre sees only its smallest neighbour, by a window-free min and a join), so no adjacency list is gathered in one
    task. Rounds grow with the logarithm of the longest path; each is written to the shared folder.
    """
    now = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2**40)))).first()
        if state == seen:
            break
        seen = state
        # large star: larger neighbours of each node point to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node and its smaller neighbours point to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
        now = store(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "cc")
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
