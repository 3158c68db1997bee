"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def settled(edges: DataFrame) -> bool:
    """Whether the edges (a, b), b < a, are stars: each a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for each end of an edge (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges are stars: each
    step takes a minimum per node, combined on the map side and written, and joins
    it back, so that the join's exchange is its own and a hub's rows can be split.
    Nulls and loops are dropped. The tables of each step are written.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now, k = scratch.save(now, f"{name}-0"), 0
    while not settled(now):
        k += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        low = scratch.save(low, f"{name}-m{k}")
        large = both.filter("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.save(large.filter("a > b").distinct(), f"{name}-l{k}")
        low = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), f"{name}-n{k}")
        small = large.join(low, F.col("a") == F.col("n")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        now = scratch.save(small.distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-m{k}", f"{name}-l{k}", f"{name}-n{k}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
