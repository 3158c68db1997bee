"""Percentiles by narrowing histograms against Spark's own, on skewed, tied, extreme and missing values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortilege.operators import ranks


def rows():
    rng = np.random.default_rng(4)
    out = [("a", float(x)) for x in rng.normal(size=700)] + [("b", 5.0)] * 40 + [("c", 1.0)] + [("d", float(2**k)) for k in range(60)]
    out += [("e", float(x)) for x in rng.integers(0, 4, 300)] + [(None, float(i)) for i in range(11)] + [("f", None), ("g", math.nan), ("g", 2.0)]
    out += [("h", 1e300), ("h", -1e300), ("h", 1.0), ("h", 1.0 + 2**-52)] + [("i", math.inf), ("i", -math.inf), ("i", 0.5), ("i", 0.7), ("i", -3.0)]
    return out


@pytest.mark.parametrize("share", [0.0, 0.1, 0.4, 0.5, 0.77, 1.0])
@pytest.mark.parametrize("buckets, levels", [(4096, 2), (3, 2), (2, 0)])
def test_as_percentile(spark, share, buckets, levels):
    d = spark.createDataFrame(rows(), "k string, v double").repartition(3)
    got = {r.k: (r.n, r.p) for r in ranks.percentile(d, ["k"], "v", share, buckets=buckets, levels=levels).collect()}
    want = {r.k: (r.n, r.p) for r in d.filter("v IS NOT NULL AND NOT isnan(v)").groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", share).alias("p")).collect()}
    assert set(got) == set(want) and "f" not in got
    for k in want:
        assert got[k] == want[k] or math.isnan(got[k][1]) and math.isnan(want[k][1]), k


def test_whole_numbers_and_two_keys(spark):
    d = spark.range(5000).selectExpr("id % 3 a", "cast(id % 2 as string) b", "id * id % 997 v")
    got = sorted(map(tuple, ranks.percentile(d, ["a", "b"], "v", 0.4, "q").collect()))
    assert got == sorted(map(tuple, d.groupBy("a", "b").agg(F.count("v"), F.percentile("v", 0.4)).collect()))
    assert ranks.percentile(d.limit(0), ["a"], "v", 0.5).count() == 0


def test_no_task_buffers_a_group(spark):
    """The plan holds no percentile aggregate, whose buffer grows with a group's different values."""
    d = spark.range(100).selectExpr("id % 2 k", "cast(id as double) v")
    plan = ranks.percentile(d, ["k"], "v", 0.5)._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect" not in plan
