"""Linkage of cards to draws against all pairs; no pair of a large group is made."""

import datetime as dt

from sortilege.operators import core as op

DRAWS = "game string, number int, draw_number long, draw_date date"
CARDS = "card_id long, game string, number int, card_date date"


def test_best_match_is_right(spark):
    day = lambda i: None if i is None else dt.date(2024, 1, 1) + dt.timedelta(i)
    draws = [("ab"[i % 2], i * 7 % 5, i, day(i * 5 % 11)) for i in range(60)] + [("a", 1, 99, None), (None, 1, 98, day(1))]
    cards = [(i % 35, "abc"[i % 3], i % 6, day(i % 13 if i % 9 else None)) for i in range(50)] + [(200, None, 1, day(1))]
    want = {}
    for c, game, number, date in cards:
        for g, n, k, d in draws:
            if game is not None and (g, n) == (game, number):
                r = (date is None or d != date, d is not None, d or dt.date.min, k)
                want[c] = min(want.get(c, r), r)
    got = op.best_match(spark.createDataFrame(cards, CARDS), spark.createDataFrame(draws, DRAWS)).collect()
    assert {r.card_id: (r.draw_number, r.method) for r in got} == {c: (r[3], "numbers" if r[0] else "numbers+date") for c, r in want.items()}


def test_best_match_of_one_large_group(spark):
    """200,000 draws and cards of one game and number are 40 billion pairs."""
    d = spark.range(200_000).selectExpr("'g' AS game", "1 AS number", "id AS draw_number", "date_add(DATE'2000-01-01', CAST(id % 3000 AS INT)) AS draw_date")
    got = op.best_match(d.selectExpr("draw_number AS card_id", "game", "number", "draw_date AS card_date"), d)
    assert got.filter("draw_number = card_id % 3000 AND method = 'numbers+date'").count() == 200_000
