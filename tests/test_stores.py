"""Bucketed merges, postings, deep pages and shapes on small data."""

import pytest
from pyspark.sql import functions as F

from sortilege.functions.format import Projection
from sortilege.operators import postings, shapes
from sortilege.operators import serving as sv
from sortilege.sources import sinks
from sortilege.sources.buckets import Buckets, Conflict

SCHEMA = "game string, draw_number long, source string, jackpot_cents long, wins int, fetched_at timestamp"


def rows(spark, numbers, jackpot, day):
    return spark.createDataFrame([("g", n, "a", jackpot, None if n and n % 2 else 1) for n in numbers], "game string, draw_number long, source string, jackpot_cents long, wins int").withColumn("fetched_at", F.lit(day).cast("timestamp"))


def names(table):
    return {(r.b, r.f) for r in table.read().select(table._bucket().alias("b"), F.col("_metadata.file_path").alias("f")).distinct().collect()}


def test_merge_touches_changed_buckets_only(spark, tmp_path):
    t = Buckets(spark, f"file://{tmp_path}/t", SCHEMA, ["game", "draw_number", "source"], 8)
    assert t.read().count() == 0 and t.merge(rows(spark, [], 1, "2024-01-01"), sinks.merge_draws) == 0
    first = rows(spark, range(100), 5, "2024-01-01").unionByName(rows(spark, [None, None], 5, "2024-01-01"))
    assert t.merge(first, sinks.merge_draws) == 1
    before, new = names(t), rows(spark, [3, 500], 7, "2024-02-01")
    touched = {r.b for r in new.select(t._bucket().alias("b")).collect()}
    assert t.merge(new, sinks.merge_draws) == 2
    after = names(t)
    assert {x for x in before if x[0] not in touched} == {x for x in after if x[0] not in touched} and len(touched) < 8
    key = lambda df: sorted(map(str, df.collect()))
    assert key(t.read()) == key(sinks.merge_draws(first, new)) and key(t.read(1)) == key(sinks.merge_draws(first, first.limit(0)))
    # A merge that fails halfway, and one that moves rows, change nothing.
    for how in (lambda o, n: o.unionByName(n).withColumn("wins", F.raise_error(F.lit("halfway")).cast("int")), lambda o, n: n.withColumn("draw_number", F.col("draw_number") + 1)):
        with pytest.raises(Exception):  # noqa: B017
            t.merge(new, how)
    assert t.last() == 2 and names(t) == after
    with pytest.raises(Conflict):
        t._commit(2, {})
    assert t.sweep() > 0 and names(t) == after and key(t.read()) == key(sinks.merge_draws(first, new))


def draws(spark):
    x = spark.range(900).selectExpr("if(id % 3 = 0, 'h', 'g') game", "if(id % 50 = 7, null, id) draw_number", "if(id % 40 = 3, null, date_add(date'2024-01-01', cast(sqrt(id) as int))) draw_date", "array(cast(id % 36 as int), 7) numbers", "if(id % 2 = 0, 'a', 'b') source")
    return x.repartition(4)


@pytest.mark.parametrize("text", ["2024", "-01", "12", "7", "[3", ", 7]", "zzz", "4-0", "1_", "20%", None, "", "024-01-1", "\\d"])
def test_postings(spark, tmp_path, text):
    d = draws(spark)
    postings.build(d, f"file://{tmp_path}/p")
    p = spark.read.parquet(f"file://{tmp_path}/p")
    want = d.filter(F.col("draw_number").isNotNull() & sv.matching(text))
    got = postings.search(d, p, text)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    if text and postings.usable(text):
        assert "In(gram" in postings.candidates(p, text)._jdf.queryExecution().toString() or "EqualTo(gram" in postings.candidates(p, text)._jdf.queryExecution().toString()


def test_deep_pages(spark):
    d = draws(spark).withColumn("draw_date", F.when(F.col("draw_number") % 5 == 0, F.lit("2024-03-03").cast("date")).otherwise(F.col("draw_date"))).cache()
    for text in (None, "1"):
        for number in (0, 1, 2, 7, 30, 99):
            got = sv.deep_page(d, "g", number, text, 20).collect()
            assert got == sv.page(d, "g", number, text, 20)[0].collect(), (number, text)
    plan = sv.deep_page(d, "g", 20, None, 20)
    assert plan.count() == 20


def test_paths_and_insides(spark):
    outer, hole = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]], [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0]]
    geo = spark.createDataFrame([([[outer, hole], [[[20.0, 0.0], [21.0, 0.0], [20.5, 3.0]]], [[]]],)], "polygons array<array<array<array<double>>>>")
    to = Projection(0, 0, 10, 10, 0, 0, 100, 100, 0)
    path = geo.select(shapes.svg_path(F.col("polygons"), to)).first()[0]
    x, y = (v[0] for v in geo.select(*to.xy(F.lit(10.0), F.lit(0.0))).collect()), None
    assert path.count("M") == path.count("Z") == 3 and path.startswith("M") and path.count("L") == 4 + 3 + 2
    assert path.split("L")[0] == f"M{next(x):.2f},100.00"
    assert [r.lon0 for r in shapes.boxes(geo.select(F.expr("slice(polygons, 1, 2)").alias("polygons"))).collect()] == [0.0, 20.0]
    s = spark.createDataFrame([("square", [outer, hole]), ("tip", [[[20.0, 0.0], [21.0, 0.0], [20.5, 3.0]]])], "name string, rings array<array<array<double>>>")
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 20.5, 1.0), (4, 20.1, 2.0), (5, 5.0, 6.5), (6, 11.0, 5.0), (7, 3.0, 4.0)], "id int, lon double, lat double")
    assert {r.id: r.name for r in shapes.within(p, s).collect()} == {2: "square", 3: "tip", 5: "square", 7: "square"}


def test_insides_of_long_rings(spark):
    """Places in tangled rings of several blocks and ranges, held against every edge; equal shapes count each, points without a place not at all."""
    import random

    r, old = random.Random(3), (shapes.EDGES, shapes.PLACES)
    ring = lambda n: [[r.randrange(40) / 4, r.randrange(40) / 4] for _ in range(n)]
    kinds = [("a", [ring(90), ring(3)]), ("b", [ring(50)]), ("b", [ring(4)]), ("c", [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0]]]), ("c", [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0]]]), ("d", [[]])]
    at = [(i, r.randrange(80) / 8, r.randrange(80) / 8) for i in range(300)] + [(400, None, 1.0), (401, 1.0, None)]

    def odd(rings, x, y):
        edges = [(g[i], g[i - 1]) for g in rings for i in range(len(g))]
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in edges) % 2

    s = spark.createDataFrame(kinds, "name string, rings array<array<array<double>>>")
    shapes.EDGES, shapes.PLACES = 20, 60
    try:
        got = shapes.within(spark.createDataFrame(at, "id int, lon double, lat double"), s)
        assert "aggregate(" not in got._jdf.queryExecution().toString(), "no point walks a ring"
        got = sorted((x.id, x.name) for x in got.collect())
    finally:
        shapes.EDGES, shapes.PLACES = old
    assert got == sorted((i, n) for i, x, y in at[:300] for n, g in kinds if odd(g, x, y))


def test_postings_tasks_are_bounded(spark, tmp_path, monkeypatch):
    """Files of postings grow in number with the rows, however many shuffle partitions a session has, and a search finds the same."""
    monkeypatch.setattr(postings, "TASK_ROWS", 500)
    d = draws(spark)
    postings.build(d, f"file://{tmp_path}/p")
    p = spark.read.parquet(f"file://{tmp_path}/p")
    sizes = [r["count"] for r in p.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 2000 and sum(sizes) == p.count()
    want = d.filter(F.col("draw_number").isNotNull() & sv.matching("024-01-1"))
    assert sorted(map(str, postings.search(d, p, "024-01-1").collect())) == sorted(map(str, want.collect()))
