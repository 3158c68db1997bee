"""Parsers by golden cases, tails by published values, formats, and text helpers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sortilege.functions import format as fm
from sortilege.functions import parse, tails
from sortilege.operators import winners as wn

DAY = dt.date
CASES = [
    (parse.archive_date, {"02-Jun-10": DAY(2010, 6, 2), "5-Jun-10": DAY(2010, 6, 5), " 5-jun-2010 ": DAY(2010, 6, 5), "01-Jan-79": DAY(2079, 1, 1), "01-Jan-80": DAY(1980, 1, 1), "31-Feb-10": None, "02-June-10": None, "2-Jux-10": None, "": None}),
    (parse.clock, {"20:25:00": "20:25", "6:55 pm": "18:55", "12:05 am": "00:05", "12:05 PM": "12:05", "8:30PM": "20:30", "25:00": None, "13:00 pm": None, "6:55 p": None, "9:75": "09:75", "": None}),
    (parse.normal_period, {"am": "Morning", " PM ": "Evening", "midday": "Midday", "late night": "Late Night", "": None, " ": None}),
    (parse.period_time, {"Morning": "10:30", " pm ": "19:00", "noon": None}),
    (parse.cents, {"$5,170,673.15": 517067315, "1.5 million": 150000000, "2k": 200000, "0.125": 12, "0.375": 38, "X": None, "tba": None, "-5.00": None, "-": None, "": None, "3 apples": None}),
    (parse.cents_of_thousandths, {"2180000000": 218000000, "5": 0, "15": 2, "": None, "x": None}),
    (parse.integer, {"-3": -3, " 12 ": 12, "12.5": None, "": None, "X": None}),
    (lambda c: F.array_join(F.transform(parse.numbers(c), lambda x: x.cast("string")), " "), {"3-13-14-31-34": "3 13 14 31 34", "4|5|7|9|19": "4 5 7 9 19", "2 17, 1234 x": "2 17", "": ""}),
    (parse.header, {"Draw#": "draw", "Draw  # ": "draw", "Power   Ball": "power ball"}),
    (lambda c: parse.winner_date(c, F.lit("2026-08-23").cast("date")), {"Friday 9th January, 2026": DAY(2026, 1, 9), "December 1st": DAY(2025, 12, 1), "August 23rd": DAY(2026, 8, 23), "February 29th": DAY(2024, 2, 29), "Decxmber": None, "31st February, 2026": None}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_parsers(spark, case):
    f, want = CASES[case]
    rows = spark.createDataFrame([*want.items(), (None, None)], "t string, w string" if not any(isinstance(x, (DAY, int)) for x in want.values()) else "t string, w date" if any(isinstance(x, DAY) for x in want.values()) else "t string, w long")
    assert {r.t: r.x for r in rows.select("t", f(F.col("t")).alias("x")).collect() if r.t is not None} == want


def test_dates_of_either_order(spark):
    rows = [("20250802", None, DAY(2025, 8, 2)), ("08/19/2026", None, DAY(2026, 8, 19)), ("22/08/2026", None, DAY(2026, 8, 22)), ("03/04/2026", DAY(2026, 4, 3), DAY(2026, 4, 3)), ("03/04/2026", None, DAY(2026, 3, 4)), ("05-06-2020", None, DAY(2020, 5, 6)), ("2020/06/05", None, DAY(2020, 6, 5)), ("2020-6-5", None, DAY(2020, 6, 5)), ("40/40/2020", None, None), ("20251345", None, None), ("2020-06-05T10", None, None)]
    got = spark.createDataFrame(rows, "t string, h date, w date").select("w", parse.either_date(F.col("t"), F.col("h")).alias("x")).collect()
    assert [r.x for r in got] == [r.w for r in got]


def test_tails():
    near = lambda a, b: abs(a - b) <= 1e-9 + 1e-6 * abs(b)
    assert near(tails.chi2_sf(3.841458820694124, 1), 0.05) and near(tails.chi2_sf(18.307038053275146, 10), 0.05)
    assert near(tails.normal_sf(1.959963984540054), 0.025)
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1) if math.comb(n, i) * p**i * (1 - p) ** (n - i) <= math.comb(n, k) * p**k * (1 - p) ** (n - k) * (1 + 1e-7))
    for k, n, p in [(0, 10, 0.3), (3, 10, 0.3), (7, 10, 0.3), (10, 10, 0.5), (5, 10, 0.5), (2, 50, 0.001), (40, 60, 0.5), (1, 1, 0.9)]:
        assert near(tails.binom_two_sided(k, n, p), min(1.0, exact(k, n, p))), (k, n, p)
    assert 0 < tails.binom_two_sided(501_500, 1_000_000, 0.5) < 0.01
    pmf = lambda i, m: math.exp(-m + i * math.log(m) - math.lgamma(i + 1))
    for k, m in [(0, 2.5), (2, 2.5), (3, 2.5), (9, 2.5), (50, 50.0)]:
        side = sum(pmf(i, m) for i in (range(k, k + 400) if k >= m else range(k + 1)))
        assert near(tails.poisson_two_sided(k, m), min(1.0, 2 * side))
    far = 2 * sum(pmf(i, 50.0) for i in range(200, 500))
    assert far > 0 and abs(tails.poisson_two_sided(200, 50.0) / far - 1) < 1e-6
    assert near(tails.kolmogorov_sf(1.3580986393), 0.05) or abs(tails.kolmogorov_sf(1.358) - 0.05) < 1e-3
    assert tails.tail("none", 1.0, 1.0, 1.0) is None and tails.tail("chi2", 1.0, 0.0, 0.0) is None


def test_formats(spark):
    r = spark.range(1).select(
        fm.money(F.lit(123456)).alias("a"), fm.money(F.lit(None).cast("long")).alias("b"), fm.compact_money(F.lit(123456789)).alias("c"), fm.compact_money(F.lit(1_234_500)).alias("d"), fm.compact_money(F.lit(12_345)).alias("e"),
        fm.p_value(F.lit(0.00001234)).alias("f"), fm.p_value(F.lit(0.00001234), 2, "n/a").alias("g"), fm.p_value(F.lit(0.25)).alias("h"), fm.p_value(F.lit(None).cast("double"), 2, "n/a").alias("i"),
    ).first()
    assert tuple(r) == ("$1,234.56", "-", "$1.23M", "$12k", "$123", "1.2e-05", "1.23e-05", "0.2500", "n/a")


def test_outlets(spark):
    want = {
        "Crystal's Bar, Toco": [("Crystal's Bar", None, "Toco")],
        "Joe; Ann, South": [("Joe", None, None), ("Ann", None, "South")],
        'Joe\n"12 Main Road, Arima"\nAnn\n#4 High Street': [("Joe", "12 Main Road, Arima", "Arima"), ("Ann", "#4 High Street", None)],
        "Shop, 5 Mall": [("Shop, 5 Mall", None, None)],
        "1 Lane\n2 Lane\n3 Lane; Joe": [("1 Lane", None, None), ("2 Lane", None, None), ("3 Lane", None, None), ("Joe", None, None)],
        "Joe\n1 Lane\n2 Lane, Town": [("Joe", "1 Lane", None), ("2 Lane", None, "Town")],
        '  " Joe ",; \u00a0,Ann, ': [('Joe "', None, None), ("Ann", None, None)],
        "A, B, C": [("A, B", None, "C")], "Joe\n5 Road, 6 Mall": [("Joe", "5 Road, 6 Mall", "6 Mall")], None: [], " ; \n": [], "": [],
    }
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", wn.split_locations("t").alias("o")).collect()
    for r in got:
        assert [(o.outlet, o.address, o.area) for o in r.o] == want[r.t] and [o.seq for o in r.o] == list(range(1, len(r.o) + 1)), (r.t, r.o)


def test_places_are_normal(spark):
    texts = ["Café  &  Co, P.O.S.", "St. Ann's", "12 E.M.R. Arima", None, ""]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(wn.normal_place(F.col("t")).alias("x")).collect()]
    assert got == ["CAFE AND CO PORT OF SPAIN", "ST ANN'S", "12 EASTERN MAIN ROAD ARIMA", "", ""]
