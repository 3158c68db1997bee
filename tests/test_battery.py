"""Small cases of the battery: exact values, ties, nulls and empty tables."""

from sortilege.operators import battery as bt
from sortilege.operators import core as op

DRAWS = "game string, draw_number long, draw_date string, number int"


def test_changepoint_is_exact(spark):
    rows = [("g", i, f"2024-01-{i:02d}", 1 if i <= 5 else 2) for i in range(1, 11)]
    got = {r.number: r for r in bt.rate_changepoints(spark.createDataFrame(rows, DRAWS), least=10).collect()}
    assert set(got) == {1, 2}
    assert (got[1].at, got[1].before, got[1].after) == (5, 1.0, 0.0)
    assert (got[2].at, got[2].before, got[2].after, got[2]["rank"]) == (5, 0.0, 1.0, 1)


def test_places(spark):
    rows = [(1, "nearby Port", "x"), (2, "Portal", "at St. Ann's"), (3, None, "PORT OF CALL"), (4, "", None)]
    got = bt.match_place(spark.createDataFrame(rows, "id int, area string, outlet string"), ["port", "port of call", "st. ann's"], "area", "outlet")
    assert {r.id: r.place for r in got.collect()} == {1: "PORT", 2: "ST. ANN'S", 3: "PORT OF CALL", 4: None}


def test_many_places(spark):
    """The join gives what a search for each name in each field gives, with names inside names, signs and other alphabets."""
    import random
    import re

    rng = random.Random(3)
    parts = ["port", "of", "st.", "ann's", "bay", "new-port", "a1", "é", "x"]
    names = list(dict.fromkeys(" ".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(60))) + ["ПОРТ", "é", " ", "", "Bay\\E", "bay  of"]
    word = lambda: rng.choice([*parts, "ports", "порт", "bay  of", "st. ann's,", "-bay-", "BAY\\E"])
    rows = [(i, *[None if rng.random() < 0.1 else " ".join(word() for _ in range(rng.randint(0, 6))) for _ in "ab"]) for i in range(300)]
    ordered = sorted(dict.fromkeys(n.upper() for n in names if n.strip()), key=len, reverse=True)
    want = {}
    for i, *fields in rows:
        hits = [n for f in fields if f is not None for n in ordered if re.search(rf"(?<![A-Z0-9]){re.escape(n)}(?![A-Z0-9])", f.upper())]
        want[i] = hits[0] if hits else None
    got = bt.match_place(spark.createDataFrame(rows, "id int, a string, b string"), names, "a", "b")
    assert {r.id: r.place for r in got.collect()} == want and got.columns == ["id", "a", "b", "place"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "NEW-PORT" not in plan  # no pattern for each name


def test_empty(spark):
    none = spark.createDataFrame([], DRAWS)
    assert not bt.rate_changepoints(none).collect()
    assert not op.autocorrelation(none, (1, 2)).collect()
    assert not bt.examples_outside(none, 1, 9).collect()
    assert not bt.bonus_frequency(none, "number").collect()


def test_false_discovery_rates(spark):
    """Against the definition, with ties, ends, missing figures and columns of clashing names."""
    import math

    import numpy as np

    rng = np.random.default_rng(8)
    ps = [float(x) for x in rng.random(400) ** 3] + [0.0, 1.0, 0.5, 0.5, 0.5, None, float("nan"), 0.01, 0.01]
    df = spark.createDataFrame([(i, p, 7) for i, p in enumerate(ps)], "id int, p_value double, rank int").repartition(5)
    known = sorted(p for p in ps if p is not None and not math.isnan(p))
    m, best, q = len(known), 1.0, {}
    for k in range(m, 0, -1):
        best = min(best, known[k - 1] * m / k)
        q[known[k - 1]] = min(q.get(known[k - 1], 9.0), best)
    got = op.benjamini_hochberg(df)
    assert got.columns == ["id", "p_value", "rank", "q_value"]
    rows = got.collect()
    assert len(rows) == len(ps)
    for r in rows:
        assert r.q_value is None if r.p_value is None or math.isnan(r.p_value) else abs(r.q_value - q[r.p_value]) < 1e-12
    assert op.benjamini_hochberg(df.limit(0)).count() == 0
