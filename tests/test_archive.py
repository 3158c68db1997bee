"""Merging, eras, sequences and the battery on small archives, against plain Python."""

import datetime as dt
import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sortilege.operators import core as op
from sortilege.operators import draws as dr
from sortilege.operators import fits, nulls
from sortilege.operators import results as rs
from sortilege.operators import sequence as sq

DRAWS = "game string, draw_number long, draw_date date, draw_time string, draw_period string, dow int, numbers array<int>, bonus_number int, multiplier string, promo string, jackpot_cents long, wins int, source string"
GAMES = "code string, pool_min int, pool_max int, bonus_name string, bonus_pool_min int, bonus_pool_max int, ordered boolean, has_jackpot boolean"


def day(i, per=1):
    return dt.date(2000, 1, 1) + dt.timedelta(i // per)


def row(game, i, numbers, source="a", jackpot=None, wins=None, bonus=None, date=None, time=None, per=1):
    return (game, i, date or day(i or 0, per), time, "Morning" if (i or 0) % 2 else "Evening", None, numbers, bonus, None, None, jackpot, wins, source)


def test_merge(spark):
    rows = [
        row("g", 1, [1], "b", jackpot=5, time="10:00"), row("g", 1, [2], "a", jackpot=None), row("g", 2, [0], "a"), row("g", 2, [3], "b", wins=1),
        row("g", 3, [4], "c"), row("g", 3, [5], "b"), row("g", None, [6], "a"), row("g", None, [6], "a"), row("z", 4, [0, 0], "a"),
    ]
    d = spark.createDataFrame(rows, DRAWS)
    got = {(r.game, r.draw_number): (r.numbers, r.jackpot_cents, r.draw_time, r.wins, r.source) for r in dr.load_draws(d, ["a", "b"], ["z"]).collect()}
    assert got == {("g", 1): ([2], 5, "10:00", None, "a+b"), ("g", 2): ([3], None, None, 1, "b"), ("g", 3): ([5], None, None, None, "b+c"), ("z", 4): ([0, 0], None, None, None, "a")}
    assert ("z", 4) not in {(r.game, r.draw_number) for r in dr.load_draws(d, ["a", "b"]).collect()}


@pytest.mark.parametrize("size", [7, 50_000])
def test_sequences_do_not_depend_on_stretches(spark, size):
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], i, day(i, 6), int(rng.integers(0, 9))) for i in range(120)]
    d = spark.createDataFrame(rows, "game string, draw_number long, draw_date date, v int").repartition(3)
    s = sq.sequence(d)
    near = {(r.game, r.nth): (r.p, r.q) for r in sq.neighbours(s, {"p": ("v", 3), "q": ("v", -2)}, size).collect()}
    upto = {(r.game, r.nth): r.t for r in sq.running(s, F.col("v"), "t", size).collect()}
    isl = Counter((r.game, r.v, r.first, r.last) for r in sq.islands(s, "v", size).collect())
    for g in "ab":
        x = [r[3] for r in rows if r[0] == g]
        for i in range(len(x)):
            assert near[g, i + 1] == (x[i - 3] if i >= 3 else None, x[i + 2] if i + 2 < len(x) else None)
            assert upto[g, i + 1] == sum(x[: i + 1])
        at = 0
        for v, run in itertools.groupby(x):
            n = len(list(run))
            assert isl[g, v, at + 1, at + n] == 1
            at += n
    assert not sq.sequence(d.limit(0)).collect()


def eras_by_hand(seq, least=200):
    """The eras of one game's draws (lists of numbers) in plain Python."""
    freq = Counter(x for d in seq for x in d)
    ok = {v for v, c in freq.items() if c >= 3}
    tops, n = [max([x for x in d if x in ok], default=min(ok)) for d in seq], len(seq)
    h = max(60, min(400, n // 12)) // 2
    roll = [max(tops[max(0, i - h) : i + h + 1]) for i in range(n)]
    parts = []
    for v, g in itertools.groupby(range(n), key=roll.__getitem__):
        g = list(g)
        if parts and len(g) < least:
            parts[-1][1] = g[-1] + 1
        else:
            parts.append([g[0], g[-1] + 1, v])
    for p, q in zip(parts, parts[1:]):
        over = [j for j in range(p[0], q[1]) if tops[j] > min(p[2], q[2])]
        if over and p[0] < (at := over[0] if q[2] > p[2] else over[-1] + 1) < q[1]:
            p[1] = q[0] = at
    return [(a + 1, b, max(x for d in seq[a:b] for x in d if x in ok)) for a, b, _ in parts]


def test_pool_eras(spark):
    rng = np.random.default_rng(5)
    tops = {"moves": [20] * 450 + [25] * 400 + [20] * 500, "drops": [36] * 700 + [35] * 600, "still": [30] * 900, "short": [9] * 399}
    rows, series = [], {}
    for game, pool in tops.items():
        series[game] = [sorted(rng.choice(np.arange(1, t + 1), 5, replace=False).tolist()) for t in pool]
        series[game][40][0] = 77  # a slip of the pen makes no era
        rows += [row(game, i, x) for i, x in enumerate(series[game])]
    d = spark.createDataFrame(rows, DRAWS)
    got: dict = {}
    for r in sorted(dr.pool_eras(d).collect(), key=lambda r: (r.game, r.first)):
        got.setdefault(r.game, []).append((r.first, r.last, r.pool_max))
    assert set(got) == {"moves", "drops"}
    for game, eras in got.items():
        assert eras == eras_by_hand(series[game])
    assert [e[2] for e in got["moves"]] == [20, 25, 20] and abs(got["moves"][0][1] - 450) < 10
    assert not dr.pool_eras(d.limit(0)).collect()


def test_moved_borders():
    """Borders from the extremes of segments are those of a search through every draw, whatever the segments."""
    rng = np.random.default_rng(11)
    for _ in range(4000):
        parts, at, tops, extremes = [], 1, [], {}
        for i in range(rng.integers(2, 7)):
            n = int(rng.integers(1, 9))
            x = rng.integers(1, 6, n)
            # As in a rolling maximum, a segment's own draws may lie above it only where short ones were joined to it.
            roll = int(rng.integers(1, 6)) if rng.random() < 0.5 else int(x.max())
            parts.append([roll, at, at + n - 1, [i]])
            tops += x.tolist()
            extremes[i] = [(v, at + int(np.flatnonzero(x == v)[0]), at + int(np.flatnonzero(x == v)[-1])) for v in set(x.tolist())]
            at += n
        want = [[a, z] for _, a, z, _ in parts]
        for i in range(1, len(parts)):
            bar = min(parts[i - 1][0], parts[i][0])
            over = [j for j in range(want[i - 1][0], parts[i][2] + 1) if tops[j - 1] > bar]
            if over and want[i - 1][0] < (start := over[0] if parts[i][0] > parts[i - 1][0] else over[-1] + 1) <= parts[i][2]:
                want[i - 1][1], want[i][0] = start - 1, start
        assert dr.moved(parts, extremes) == want


def test_floor_and_drops(spark):
    figures = [100, 100, 150, 200, 100, 100, 300, 250, 100, 500, 495, 600, None, 0, 700, 100]
    rows = [row("g", i, [1], jackpot=v, wins=[None, 0, 1][i % 3]) for i, v in enumerate(figures)] + [row("g", 100 + i, [1], jackpot=100) for i in range(10)] + [row("few", i, [1], jackpot=v) for i, v in enumerate([9, 3])]
    d = spark.createDataFrame(rows, DRAWS)
    seq = [(r[1], r[10], r[11]) for r in rows if r[0] == "g" and r[10]]
    want = {}
    for (n, cur, wins), (_, nxt, _) in zip(seq, seq[1:]):
        ratio = nxt / cur
        if cur <= 102:
            want["g", n] = ("at_jackpot_floor", "undetermined", 0.0, None)
        elif ratio < 1:
            c = 0.95 if ratio < 0.7 else 0.7 if ratio < 0.9 else 0.35
            want["g", n] = ("jackpot_drop" if ratio < 0.9 else "jackpot_drop_small", "win", c, None if wins is None else int((wins > 0) == (c >= 0.6)))
    want["few", 0] = ("jackpot_drop", "win", 0.95, None)
    assert {(r.game, r.draw_number): (r.method, r.verdict, r.confidence, r.agrees_with_published) for r in op.inferred_wins(d).collect()} == want
    assert {r.draw_number for r in op.undetermined_draws(d).collect()} == {n for n, v, _ in seq if v <= 102}


def archive(spark, n=700):
    rng = np.random.default_rng(11)
    rows = [row("sets", i, sorted(rng.choice(np.arange(1, 13), 4, replace=False).tolist()), per=2) for i in range(n)]
    rows += [row("one", i, [int(rng.integers(0, 10))], wins=int(rng.random() < 0.2), jackpot=1000 + 10 * i, bonus=int(rng.integers(1, 4))) for i in range(n)]
    rows += [row("one", i, r[6], "b", jackpot=2 * r[10]) for i, r in enumerate(rows[n : n + 30])]
    games = [("sets", 1, 12, None, None, None, False, False), ("one", 0, 9, "extra", 1, 5, False, True)]
    return rows, rs.Slices(spark.createDataFrame(rows, DRAWS), spark.createDataFrame(games, GAMES), ["a", "b"], ["one"], sims=400)


def test_battery(spark):
    rows, s = archive(spark)
    got = {(r.game, r.test, r.scope): r for r in rs.run(s).collect()}
    sets = [r[6] for r in rows if r[0] == "sets"]
    n, pairs = len(sets), Counter(p for x in sets for p in itertools.combinations(x, 2))
    e = n * 6 / 66
    r = got["sets", "pair_cooccurrence", "all pairs"]
    assert math.isclose(r.statistic, sum((pairs[p] - e) ** 2 / e for p in itertools.combinations(range(1, 13), 2))) and r.dof == 65 and r.n == n
    r = got["sets", "consecutive_numbers", "any adjacent pair"]
    assert r.statistic == sum(any(b - a == 1 for a, b in zip(x, x[1:])) for x in sets) and math.isclose(r.effect, r.statistic / n - (1 - math.comb(9, 4) / math.comb(12, 4)))
    r = got["sets", "repeat_sets", "identical number sets"]
    assert r.statistic == n - len(set(map(tuple, sets))) and 0 < r.p_value <= 1
    for lag in (1, 2, 3):
        assert got["sets", "lag_repeat", f"lag {lag}"].statistic == sum(len(set(a) & set(b)) for a, b in zip(sets, sets[lag:]))
    r = got["sets", "number_frequency", "all draws"]
    c = Counter(x for v in sets for x in v)
    assert math.isclose(r.statistic, sum((c[v] - n / 3) ** 2 / (n / 3) for v in range(1, 13))) and r.dof is None and 0 < r.p_value <= 1
    r = got["one", "bonus_frequency", "extra"]
    assert r.n == n and r.dof == 2
    assert got["one", "source_agreement", "overlapping draws"].n == 30 and got["one", "source_agreement", "overlapping draws"].statistic == 0
    assert got["one", "money_scale_calibration", "jackpots of two sources"].statistic == 0.5
    assert got["one", "rollover_geometry", "rollover run lengths"].n == sum(r[11] or 0 for r in rows)
    assert ("one", "autocorrelation", "lag 10") in got and ("one", "number_by_period", "draw period x number") in got
    assert not any(k[0] == "sets" and k[1] in ("autocorrelation", "bonus_frequency", "rollover_geometry") for k in got)
    tested = sorted((r for r in got.values() if r.p_value is not None), key=lambda r: r.p_value)
    assert all(r.q_value >= r.p_value for r in tested) and all(r.q_value is None for r in got.values() if r.p_value is None)


def test_nulls(spark):
    """The closed forms agree with permutations and simulations."""
    rng = np.random.default_rng(2)
    sets = [sorted(rng.choice(10, 3, replace=False, p=np.arange(1, 11) / 55).tolist()) for _ in range(400)]
    r = nulls.order_null(spark.createDataFrame([("g", x) for x in sets], "game string, numbers array<int>")).first()
    x = np.zeros((400, 10))
    for i, v in enumerate(sets):
        x[i, v] = 1
    seen = []
    for _ in range(3000):
        p = x[rng.permutation(400)]
        seen.append((p[1:] * p[:-1]).sum())
    assert abs(np.mean(seen) - 399 * r.pair_mean) < 4 * np.std(seen) / 3000**0.5
    assert abs(np.var(seen) / (399 * r.pair_variance) - 1) < 0.12
    for draws, pool, k in ((200, 7, 3), (40, 20, 6), (90, 5, 4)):  # counts made at once against draws made one by one
        direct = np.zeros((2000, pool))
        for i in range(2000):
            direct[i] = np.bincount(np.argsort(rng.random((draws, pool)), axis=1)[:, :k].ravel(), minlength=pool)
        made = nulls.simulated_counts([1, 2], 2000, draws, pool, k)
        assert (made.sum(1) == draws * k).all() and made.max() <= draws
        assert np.abs(made.mean(0) - draws * k / pool).max() < 5 * direct.std() / 2000**0.5
        assert np.abs(np.cov(made.T) - np.cov(direct.T)).max() < 0.15 * direct.var()
        e = draws * k / pool
        chi = [np.sort(((x - e) ** 2 / e).sum(1)) for x in (made, direct)]
        assert np.abs(np.searchsorted(chi[0], chi[1], "right") / 2000 - np.arange(1, 2001) / 2000).max() < 0.06
    exact = nulls.simulated_counts([3], 20_000, 1, 4, 2)  # one draw of two of four: six sets, equally often
    assert np.abs(np.unique(exact, axis=0, return_counts=True)[1] - 20_000 / 6).max() < 300
    stats = spark.createDataFrame([("g", 14.0, 300, 12, 4), ("h", 14.0, 30_000, 12, 4), ("k", 5.0, 300, 12, 1)], "game string, chi2 double, n long, pool int, k int")
    got = {r.game: r.mc_p for r in nulls.with_frequency_p(stats, 1500).collect()}
    assert got["k"] is None and abs(got["g"] - got["h"]) < 0.05


def test_fits(spark):
    """Cells and chi-square against sums of the law's terms, run length by run length."""
    rng, rows, want = np.random.default_rng(9), [], {}
    for name, rate, n in (("g", 0.2, 500), ("rare", 0.01, 300), ("often", 0.9, 60), ("small", 0.3, 12), ("one", 1.0, 50)):
        x = rng.geometric(rate, n)
        rows += [(name, int(k), int((x == k).sum())) for k in np.unique(x)]
        p, found, due, have, law = n / x.sum(), [], 0.0, 0, []
        for k in range(1, x.max() + 1):
            due, have = due + n * p * (1 - p) ** (k - 1), have + int((x == k).sum())
            if due >= 5:
                law.append(due), found.append(have)
                due, have = 0.0, 0
        if law:
            law[-1], found[-1] = law[-1] + due, found[-1] + have
        e = np.array(law) * sum(found) / sum(law) if law else None
        want[name] = (p, float(((np.array(found) - e) ** 2 / e).sum()) if len(law) >= 3 else None, len(law) - 2 if len(law) >= 3 else None, n)
    got = {r.game: r for r in fits.geometric_fit(spark.createDataFrame([*rows, ("few", 1, 3)], "game string, length long, runs long")).collect()}
    assert set(got) == set(want) and want["g"][2] >= 3 and want["one"][1] is None
    for name, (p, chi2, dof, n) in want.items():
        r = got[name]
        assert math.isclose(r.p_hat, p) and r.runs == n and r.dof == dof and (r.chi2 is None if chi2 is None else math.isclose(r.chi2, chi2, rel_tol=1e-9)), name


def test_report(spark):
    from sortilege.operators.report import report

    f = spark.createDataFrame([("g", "t", "s", 2.5, 0.00001, 0.00003, 1234, "d"), ("g", "u", "s", None, None, None, 5, "e"), ("g", "v", "s", 1.0, 0.5, 0.5, 9, "x")], "game string, test string, scope string, statistic double, p_value double, q_value double, n long, detail string")
    cover = spark.createDataFrame([("g", 1234, "2000-01-01", "2001-01-01", 3, 4)], "game string, draws long, first_date string, last_date string, with_jackpot long, with_wins long")
    won = spark.createDataFrame([("g", 7, 2, 1, 3)], "game string, n long, strong long, agree long, checked long")
    lines = [r.line for r in report(f, cover, won).orderBy("section", "place").collect()]
    assert "| g | 1,234 | 2000-01-01 | 2001-01-01 | 3 | 4 | 7 |" in lines and "| g | t | s | 1,234 | 2.500 | 1.00e-05 | 3.00e-05 | d |" in lines
    assert lines.index("| g | v | s | 9 | 1.000 | 0.5000 | 0.5000 | x |") == lines.index("| g | t | s | 1,234 | 2.500 | 1.00e-05 | 3.00e-05 | d |") + 1
    assert "- **g / t (s)**: p=1.00e-05, q=3.00e-05. d" in lines and "- **g / u (s)**: e" in lines and "| g | 7 | 2 | 3 | 1 |" in lines
    assert "Nothing: all results are those of fair draws." in [r.line for r in report(f.filter("test = 'v'"), cover, won).collect()]


def test_failures_stay_alone(spark):
    """A test that raises leaves all others whole; one that raises for a game loses that game only; registered tests see what their flag says."""
    rows, s = archive(spark)

    def broken(s):
        raise ValueError("no such thing")

    def picky(s):
        """Fails inside a task, for one game."""
        return rs.rows(s.meta.withColumn("n", F.when(F.col("game") == "one", F.raise_error(F.lit("bad game")).cast("long")).otherwise(F.lit(7))), "picky", "s", F.col("n"))

    def eras(s, draws):
        return rs.rows(draws.groupBy("title", "tag").agg(F.count(F.lit(1)).alias("n")), "eras", "s", F.col("n"))

    before = dict(rs.REGISTRY)
    try:
        rs.register(broken)
        rs.register(picky, name="choosy")
        rs.register(eras, per_era=True)
        got = rs.run(s, ["digit_tests", "broken", "pool_calibration", "choosy", "eras"], others=[lambda: 1 / 0]).collect()
    finally:
        rs.REGISTRY.clear()
        rs.REGISTRY.update(before)
    bad = {(r.test, r.game): r.detail for r in got if r.status == "failed"}
    games = {r.game for r in s.meta.collect()}
    assert {g for t, g in bad if t == "broken"} == games and "no such thing" in bad["broken", "one"]
    assert [g for t, g in bad if t == "choosy"] == ["one"] and {r.game for r in got if r.test == "picky"} == games - {"one"}
    assert {r.status for r in got if r.test in ("eras", "pick4_all_same", "pool_calibration")} == {"ok"}
    alone = rs.run(s, ["digit_tests", "pool_calibration"]).collect()
    key = lambda r: (r.game, r.test, r.scope, r.statistic, r.p_value)
    assert {key(r) for r in alone} <= {key(r) for r in got} and all(r.q_value is None for r in got if r.status == "failed")


def test_runs_of_stretches(spark):
    """Segments of a rolling maximum that are dealt into short stretches are those of one pass over the whole game; extremes too."""
    rng = np.random.default_rng(3)
    tops = {"a": np.repeat(rng.integers(3, 9, 20), 120), "b": rng.integers(1, 50, 1500)}
    rows = [(g, i + 1, len(x), int(v)) for g, x in tops.items() for i, v in enumerate(x)]
    seq = spark.createDataFrame(rows, "game string, nth long, n long, top int")
    got = dr.numbered_runs(dr.rolling_runs(seq, size=250))
    seen = {(r.game, r.segment, r.top): (r.roll, r.a, r.z) for r in got.groupBy("game", "segment", "top").agg(F.max("roll").alias("roll"), F.min("a").alias("a"), F.max("z").alias("z")).collect()}
    want = {}
    for g, x in tops.items():
        half = max(60, min(400, len(x) // 12)) // 2
        roll = [int(x[max(0, i - half) : i + half + 1].max()) for i in range(len(x))]
        segment = np.cumsum([1, *(np.diff(roll) != 0)])
        for i, v in enumerate(x.tolist()):
            a = want.get((g, segment[i], v), (0, i + 1, 0))[1]
            want[g, segment[i], v] = (roll[i], a, i + 1)
    assert seen == want and len({k[1] for k in want if k[0] == "a"}) > 5


def test_battery_reads_its_rows_once(spark):
    """The rows of all sources are computed once, and draws that stand alone meet no others; results are those of plain rows."""
    rows, s = archive(spark)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan(s.raw) and not any("LogicalRDD" in plan(df) for df in (s.rows, s.draws, rs.source_agreement(s)))
    plain = dr.load_draws(s.raw, s.priority, s.zero_games)
    assert sorted(map(str, plain.collect())) == sorted(map(str, dr.load_draws(s.rows, s.priority, s.zero_games).collect()))
    odd = spark.createDataFrame([("g", None, "a"), ("g", None, "a"), ("g", 1, "a"), ("g", 1, "b"), ("g", 2, "b")], "game string, draw_number long, source string")
    assert sorted((str(r.draw_number), r.rows_) for r in dr.with_rows(odd).collect()) == [("1", 2), ("1", 2), ("2", 1), ("None", 2), ("None", 2)]
