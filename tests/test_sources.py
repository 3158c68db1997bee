"""Payloads, saved pages, merges and the log from small files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from sortilege.operators import serving as sv
from sortilege.operators import winners as wn
from sortilege.sources import pages, payloads, sinks
from sortilege.streaming import ingest as ig

MONTH = """<div id="results"><table><tr><tr><th>Draw#</th><th>Date</th><th>Time</th><th>Numbers</th><th>Power Ball</th><th>Multiplier</th><th>Jackpot</th><th>Wins</th></tr>
<tr><td colspan=8>02-Jun-10</td></tr>
<tr><td>11</td><td></td><td>PM</td><td>3-13-14-31-34</td><td>7</td><td>NA</td><td>$2,000.50</td><td>X</td></tr>
<tr><td>12</td><td>03-Jun-10<td>6:55 pm<td>1 2 3</td><td>x</td><td>2</td><td>X</td><td>1</td></tr>
<tr><td>no</td><td></td><td></td><td>1</td></tr><tr><td>13</td><td></td><td></td><td></td></tr></table></div>"""
FOUR = """<div id=results><table><tr><th>draw #</th><th>#1</th><th>#2</th></tr><tr><td>5-Jun-10</td></tr><tr><td>7</td><td>4</td><td>9</td></tr></table></div>"""
PICK = """<div id="results"><table><tr><th>Draw</th><th>Number</th></tr><tr><td>1-Jan-80</td></tr><tr><td>8</td><td>42</td></tr></table></div>"""


def tab(cards):
    return f'<div class="oxy-tab-content"><div class="oxy-dynamic-list">{cards}</div></div>'


CARDS = '<div class="oxy-tabs-contents-wrapper">' + "".join([
    tab('<div><span class="x winneramt-1">$5,000.00</span><div class="winnergamenumberpw">3</div><div class="winnergamenumberpw">12</div><div class="ct-text-block">2 lucky players at the 6:55 pm draw on December 1st winning</div><div class="ct-text-block">Bar, Toco</div></div><div><p>nothing</p></div>'),
    tab('<div><div class="ct-code-block">$700</div><div class="ct-text-block">Friday 9th January, 2026</div><div class="ct-text-block">Mart; Shop</div></div>'),
    tab('<div><div class="ct-code-block">$90</div><div class="ct-text-block">LUCKY LOCATION</div><div class="ct-text-block">"Joe"</div><div class="ct-text-block">sold on December 1st</div></div>'),
    tab('<div><span class="winneramt">$1 million</span> 02/05/2026 - Draw # 77 <div class="winnergamenumberlo">4</div> POWERBALL 9 MULTIPLIER 3 sold at Ann, Arima Play don\'t</div>'),
]) + "</div>"


def test_month_tables(spark):
    df = spark.createDataFrame([("u1", "lotto", MONTH), ("u2", "pick2", FOUR), ("u3", "pick4", PICK), ("u4", "lotto", "<p>none</p>"), ("u5", "lotto", None)], "url string, game string, html string")
    got = {r.draw_number: r for r in pages.month_records(df, "m").collect()}
    assert set(got) == {11, 12, 7, 8}
    a, b = got[11], got[12]
    assert (a.draw_date, a.draw_time, a.draw_period, a.numbers, a.bonus_number, a.multiplier, a.jackpot_cents, a.wins) == (dt.date(2010, 6, 2), "19:00", "Evening", [3, 13, 14, 31, 34], 7, None, 200050, None)
    assert (b.draw_date, b.draw_time, b.numbers, b.bonus_number, b.multiplier, b.jackpot_cents, b.wins) == (dt.date(2010, 6, 3), "18:55", [1, 2, 3], None, "2", None, 1)
    assert (got[7].numbers, got[7].draw_date) == ([4, 9], dt.date(2010, 6, 5)) and got[8].numbers == [0, 0, 4, 2] and got[8].draw_date == dt.date(1980, 1, 1)


def test_cards(spark):
    df = spark.createDataFrame([("u", CARDS), ("v", "")], "url string, html string")
    got = {r.game: r for r in pages.winner_records(df, "w", F.lit("2026-08-23").cast("date")).collect()}
    assert set(got) == set(pages.TABS)
    p, f, c, x = (got[g] for g in pages.TABS)
    assert (p.numbers, p.amount_cents, p.draw_date, p.draw_time, p.players, p.location_raw) == ([3, 12], 500000, dt.date(2025, 12, 1), "18:55", 2, "Bar, Toco")
    assert (f.draw_date, f.location_raw, f.amount_cents) == (dt.date(2026, 1, 9), "Mart; Shop", 70000)
    assert (c.location_raw, c.draw_date, c.numbers) == ("Joe", dt.date(2025, 12, 1), [])
    assert (x.draw_number, x.draw_date, x.draw_date_raw, x.numbers, x.bonus_number, x.multiplier, x.location_raw) == (77, None, "02/05/2026", [4], 9, "3", "Ann, Arima")


def test_payloads(spark, tmp_path):
    item = lambda slug, acf: {"id": 1, "slug": slug, "date": "2026-04-03T10:00:00", "link": "l", "acf": acf}
    page = [
        item("12-2", {"draw_date": "03/04/2026", "draw_time": "6:55 pm", "jackpot": 2180000000, "play_whe_winning_numbers": {"winning_number": "17"}, "play_whe_jackpot_winning_numbers": {f"number_{i}": i for i in (10, 2, 3, 4, 5)}}),
        item("13", {"draw_date": "20260403", "play_whe_winning_numbers": {"winning_number": ""}}), item("x", {}),
    ]
    (tmp_path / "p1.json").write_text(json.dumps(page))
    (tmp_path / "p2.json").write_text(json.dumps({"code": "error", "message": "no such page"}))
    got = sorted(payloads.records(payloads.items(spark, str(tmp_path / "p*.json")), "playwhe", "w").collect(), key=lambda r: r.game)
    assert [(r.game, r.draw_number, r.numbers, r.draw_date, r.draw_time, r.jackpot_cents) for r in got] == [("playwhe", 12, [17], dt.date(2026, 4, 3), "18:55", 218000000), ("playwhe_jackpot", 12, [2, 3, 4, 5, 10], dt.date(2026, 4, 3), "18:55", 218000000)]
    (tmp_path / "q.json").write_text(json.dumps([item("7", {"pick_4_winning_numbers": 42}), item("8", {"lotto_winning_numbers": {"number_2": 5, "number_1": 9, "power_ball": 3, "multiplier": "4"}, "current_jackpot": 50})]))
    q = payloads.items(spark, str(tmp_path / "q.json"))
    assert payloads.records(q, "pick4", "w").first().numbers == [0, 0, 4, 2]
    r = payloads.records(q, "lotto", "w").first()
    assert (r.numbers, r.bonus_number, r.multiplier) == ([9, 5], 3, "4")
    assert [(r.draw_number, r.jackpot_cents) for r in payloads.forward_estimates(q, "lotto", "w").collect()] == [(7, None), (8, 5)]
    w = spark.range(1).select(payloads.windows(F.lit("2026-01-01").cast("date"), F.lit("2026-01-15").cast("date")).alias("w")).first().w
    assert [(str(x.after), str(x.before)) for x in w] == [("2026-01-01", "2026-01-08"), ("2026-01-08", "2026-01-15"), ("2026-01-15", "2026-01-22")]


def test_merges(spark, tmp_path):
    t = lambda d: dt.datetime(2026, 1, d)
    one = lambda n, d, **k: dict(game="g", draw_number=n, source="a", fetched_at=t(d), **k)
    make = lambda rows: spark.createDataFrame([tuple(r.get(c.split()[0]) for c in sinks.DRAWS.split(", ")) for r in rows], sinks.DRAWS)
    table = sinks.Versions(spark, f"file://{tmp_path}/draws", sinks.DRAWS)
    table.write(sinks.merge_draws(table.read(), make([one(1, 1, wins=1, promo="p"), one(None, 1, wins=5)])))
    table.write(sinks.merge_draws(table.read(), make([one(1, 2, wins=2), one(None, 2, wins=6), one(2, 2)])))
    got = sorted(((r.draw_number or 0, r.wins, r.promo, r.fetched_at) for r in table.read().collect()), key=str)
    assert got == sorted([(0, 5, None, t(1)), (0, 6, None, t(2)), (1, 2, "p", t(1)), (2, None, None, t(2))], key=str)
    assert table.last() == 2
    seeds = spark.createDataFrame([("a", 1), ("b", 2)], "code string, n int")
    assert sorted(sinks.seeded(seeds.filter("code = 'a'").withColumn("n", F.lit(9)), seeds).collect()) == [("a", 9), ("b", 2)]
    old = spark.createDataFrame([("a", 1), ("b", 1)], "game string, n int")
    assert sorted(sinks.replace_games(old, spark.createDataFrame([("a", 7)], "game string, n int")).collect()) == [("a", 7), ("b", 1)]
    path = f"file://{tmp_path}/log"
    for status in ("ok", "error"):
        sinks.append(sinks.log_row(spark, "s", f"t-{status}", status, 1, "n"), path)
    log = spark.read.parquet(path)
    assert sv.ingest_summary(log).count() == 2 and sv.last_errors(log).first().target == "t-error"


def test_streamed_ingest_equals_one_batch(spark, tmp_path):
    rows = [("g", i % 7, i, i % 3 or None) for i in range(40)]
    schema = "game string, draw_number long, version long, wins long"
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ig.ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/ck", files_per_batch=1)
    got = ig.current(spark, schema, f"{tmp_path}/out", ["game", "draw_number"], "version")
    want = {n: (max(r[2] for r in rows if r[1] == n), next(r[3] for r in reversed(rows) if r[1] == n and r[3])) for n in range(7)}
    assert {r.draw_number: (r.version, r.wins) for r in got.collect()} == want
    events = spark.createDataFrame([(dt.datetime(2026, 1, 1, h), "x") for h in range(5)], "ts timestamp, event_type string")
    assert ig.late_counts(events).first().n == 5


def test_findings_pages(spark):
    f = spark.createDataFrame([(1, "g", "t", "s", 0.001, 0.01), (2, "g", "t", "s", 0.5, 0.9), (2, "g", "u", "s", None, None), (2, "h", "v", "s", 0.001, 0.03)], "run_ts int, game string, test string, scope string, p_value double, q_value double")
    assert [(r.test, r.verdict) for r in sv.latest_findings(f).collect()] == [("v", "flagged"), ("t", "consistent"), ("u", "descriptive")]
    assert [r.test for r in sv.latest_findings(f, "g").collect()] == ["t", "u"] and [r.run_ts for r in sv.runs(f).collect()] == [2, 1]
    assert tuple(sv.finding_counts(f).first()) == (3, 2, 1, 0) and sv.strongest(f, 1).first().run_ts == 1
    rows = spark.createDataFrame([("Ann", 5), ("joe", 15)], "a string, b int")
    assert sv.row_filter(rows, "N").count() == 1 and sv.row_filter(rows, "5").count() == 2 and [r.a for r in sv.options(rows, "a").collect()] == ["Ann", "joe"]
    b = sv.bars(spark.createDataFrame([("g", 1, 4, 4.0), ("g", 2, 8, 4.0)], "game string, number int, n long, expected double")).collect()
    assert {(r.number, r.z, r.height, r.hottest, r.coldest) for r in b} == {(1, 0.0, 0.5, False, True), (2, 2.0, 1.0, True, False)}


def test_winner_pages(spark):
    w = spark.createDataFrame([(1, "g", 500, dt.date(2026, 1, 1), [1], "Bar, Toco; Mart, Bay"), (2, "h", None, None, [2], None)], "id long, game string, amount_cents long, draw_date date, numbers array<int>, location_raw string")
    places = spark.createDataFrame([("Toco", 10.0, -61.0)], "name string, lat double, lon double")
    at = wn.locations(w, places)
    assert {(r.outlet, r.place, r.geo_method) for r in at.collect()} == {("Bar", "Toco", "gazetteer"), ("Mart", None, "unmatched")}
    n = wn.nested(w, at)
    assert {r.id: len(r.outlets) for r in n.collect()} == {1: 2, 2: 0}
    assert [r.id for r in wn.filtered(n, "Toco", "g", "MART").collect()] == [1] and not wn.filtered(n, game="h", place="Toco").collect()
    assert [(r.place, r.count_, r.amount_cents) for r in wn.place_markers(w, at).withColumnRenamed("count", "count_").collect()] == [("Toco", 1, 500)]
    c = w.withColumns({"draw_number": F.lit(1), "draw_date_raw": F.lit("x"), "draw_time": F.lit(None).cast("string")})
    assert wn.announcements(c.unionByName(c)).count() == 2
