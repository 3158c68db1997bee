"""Exact percentiles without a buffer of a group's values.

The values of a group are counted in buckets of equal width between its least and its
greatest; the bucket that holds the wanted rank is counted in buckets again, and what
is left of it is counted value by value. Counts combine on the map side, so a task sees at
most a bucket's worth of rows for a group, however many values it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import fitting, written

#: Buckets of a histogram; how often a bucket is counted in buckets again.
BUCKETS, LEVELS = 4096, 1


def percentile(rows: DataFrame, keys: Sequence[str], value: str, share: float, name: str = "p", buckets: int = BUCKETS, levels: int = LEVELS) -> DataFrame:
    """keys, n, name: the value at `share` (0 to 1) of each group's n values, between two of them in proportion, as `percentile` gives it.

    Null values and NaN do not count, and a group without others has no row; equal values count as often as they occur. Infinite values
    are ordered like others. keys may be null.
    """
    here = [f"k{i}_" for i in range(len(keys))]
    x = rows.select(*[F.col(k).alias(h) for k, h in zip(keys, here)], F.col(value).alias("v_")).filter(F.col("v_").isNotNull() & ~F.isnan(F.col("v_").cast("double")))
    ends = x.groupBy(*here).agg(F.count(F.lit(1)).alias("n_"), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
    at = (F.col("n_") - 1) * F.lit(float(share))
    # What is sought in each group: the row number `r_` within [lo_, hi_]; `up_` is the least value above hi_.
    state = ends.withColumn("at_", at).withColumn("r_", F.floor("at_").cast("long")).withColumn("up_", F.lit(None).cast(x.schema["v_"].dataType))
    state = written(state, "ranks")  # one row for each group
    for _ in range(levels):
        inside = _inside(x, state, here).withColumn("b_", _bucket(buckets))
        counts = inside.groupBy(*here, "b_").agg(F.count(F.lit(1)).alias("c_"), F.min("v_").alias("min_"), F.max("v_").alias("max_"))
        state = written(_narrowed(counts, state, here, "b_"), "ranks")
    counts = _inside(x, state, here).groupBy(*here, "v_").agg(F.count(F.lit(1)).alias("c_"))
    state = _narrowed(counts.withColumns({"min_": F.col("v_"), "max_": F.col("v_")}), state, here, "v_")
    # Now lo_ is the value at the whole rank below; the next one is the same, or up_ if that was its last.
    part = F.col("at_") - F.floor("at_")
    higher = F.when(F.col("last_"), F.col("up_")).otherwise(F.col("lo_"))
    got = F.when((part == 0) | (higher == F.col("lo_")), F.col("lo_").cast("double")).otherwise((F.ceil("at_") - F.col("at_")) * F.col("lo_") + part * higher)
    return state.select(*[F.col(h).alias(k) for k, h in zip(keys, here)], F.col("n_").alias("n"), got.alias(name))


def _same(here: Sequence[str], there: Sequence[str]) -> Column:
    same = F.lit(True)
    for a, b in zip(here, there):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return same


def _inside(x: DataFrame, state: DataFrame, here: Sequence[str]) -> DataFrame:
    there = [f"s{h}" for h in here]
    bounds = state.select(*[F.col(h).alias(t) for h, t in zip(here, there)], "lo_", "hi_")
    return x.join(fitting(bounds), _same(here, there) & F.col("v_").between(F.col("lo_"), F.col("hi_")))


def _bucket(buckets: int) -> Column:
    """Grows with v_ from 0 to buckets - 1; one bucket where all values are equal, infinite ends where there are such."""
    v, lo, hi = (F.col(c).cast("double") for c in ("v_", "lo_", "hi_"))
    inner = F.floor(F.try_divide(v - lo, hi - lo) * buckets).cast("int")
    endless = (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf")) | (F.abs(hi - lo) == float("inf"))
    return F.when(endless, F.signum(v).cast("int") + F.when(v == float("inf"), 1).when(v == float("-inf"), -1).otherwise(0)).otherwise(F.least(F.coalesce(inner, F.lit(0)), F.lit(buckets - 1)))


def _narrowed(counts: DataFrame, state: DataFrame, here: Sequence[str], order: str) -> DataFrame:
    """The state within the bucket that holds the row sought."""
    there = [f"s{h}" for h in here]
    w = Window.partitionBy(*here).orderBy(order)  # at most one row for each bucket
    c = counts.withColumn("upto_", F.sum("c_").over(w)).withColumn("next_", F.lead("min_").over(w))
    old = state.select(*[F.col(h).alias(t) for h, t in zip(here, there)], "n_", "at_", "r_", "up_")
    found = c.join(fitting(old), _same(here, there)).filter((F.col("upto_") > F.col("r_")) & (F.col("upto_") - F.col("c_") <= F.col("r_")))
    last = F.col("upto_") - 1 == F.col("r_")
    return found.select(*here, "n_", "at_", (F.col("r_") - (F.col("upto_") - F.col("c_"))).alias("r_"), F.col("min_").alias("lo_"), F.col("max_").alias("hi_"), F.coalesce("next_", "up_").alias("up_"), last.alias("last_"))
