"""Queries on merged draws, winners, the ingest log and the pages of a site, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import format as fm
from ..functions import parse
from ..operators import draws as dr
from ..operators import fits
from ..operators import serving as sv
from ..operators import winners as wn
from ..operators.sequence import sequence
from ..sources import sinks
from ..sources import views as v

L2 = """, l2 AS (SELECT game, draw_number, draw_date, CASE WHEN source = 'a' AND draw_number % 13 = 0 THEN [0] ELSE [number] END AS numbers,
    CASE WHEN source = 'b' THEN printf('%02d:00', hour) END AS draw_time, jackpot_cents, wins, source FROM d2)"""
MERGED = L2 + """, ld AS (SELECT game, draw_number, arg_min(draw_date, source) AS draw_date, arg_min(numbers, source) AS numbers,
    arg_min(jackpot_cents, source) FILTER (jackpot_cents IS NOT NULL) AS jackpot_cents, arg_min(draw_time, source) FILTER (draw_time IS NOT NULL) AS draw_time,
    string_agg(DISTINCT source, '+' ORDER BY source) AS source FROM l2 WHERE numbers <> [0] GROUP BY game, draw_number)"""
_N = len(v.PLACES)
PLACES = "['" + "', '".join(v.PLACES) + "']"
W1 = f""", w0 AS (SELECT *, CASE WHEN draw_number % 4 = 0 THEN draw_date + 400 ELSE draw_date END AS shown FROM d1 WHERE wins > 0),
  w1 AS (SELECT draw_number AS id, game, CASE WHEN draw_number % 3 = 0 THEN draw_number END AS draw_number, CASE WHEN draw_number % 3 <> 0 THEN shown END AS draw_date,
    strftime(shown, '%d/%m/%Y') AS draw_date_raw, jackpot_cents AS amount_cents, CASE WHEN draw_number % 9 <> 0 THEN number ELSE (number + 1) % 100 END AS number,
    CASE WHEN draw_number % 11 <> 0 THEN concat('Shop ', draw_number % 40) END AS shop, {PLACES}[draw_number % {_N} + 1] AS place,
    CASE WHEN draw_number % 11 <> 0 AND draw_number % 5 = 0 THEN concat('Kiosk ', draw_number % 7) END AS kiosk FROM w0)"""
OUT = W1 + """, o AS (SELECT id AS winner_id, 1 AS seq, shop AS outlet, place AS area FROM w1 WHERE shop IS NOT NULL
    UNION ALL SELECT id, 2, kiosk, 'North' FROM w1 WHERE kiosk IS NOT NULL)"""
MAPPED = OUT + """, m AS (SELECT *, CASE WHEN area <> 'North' THEN upper(area) END AS place FROM o)"""
LINK = W1 + """, e1 AS (SELECT game, number, min(draw_number) AS n FROM d1 GROUP BY ALL), e2 AS (SELECT game, number, draw_date AS d, min(draw_number) AS n FROM d1 GROUP BY ALL),
  lk AS (SELECT w1.id, w1.game, coalesce(w1.draw_number, e2.n, e1.n) AS draw_number, coalesce(w1.draw_date, x.draw_date) AS draw_date, w1.draw_date_raw, w1.number,
    CASE WHEN w1.draw_number IS NOT NULL THEN 'draw_number' WHEN e2.n IS NOT NULL THEN 'numbers+date' WHEN e1.n IS NOT NULL THEN 'numbers' END AS match_method
    FROM w1 LEFT JOIN d1 x ON x.game = w1.game AND x.draw_number = w1.draw_number
      LEFT JOIN e1 ON w1.draw_number IS NULL AND e1.game = w1.game AND e1.number = w1.number
      LEFT JOIN e2 ON w1.draw_number IS NULL AND e2.game = w1.game AND e2.number = w1.number AND e2.d = w1.draw_date)"""
LG = """lg AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, concat(event_type, ':', 2020 + event_id % 5, '-', ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun'][event_id % 6 + 1]) AS target,
    CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_id % 7 = 0 THEN concat('note ', event_id) END AS note, ts FROM events)"""


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("numbers", F.array_join(F.transform("numbers", lambda x: x.cast("string")), "-"))


def _singles(s, d):
    return v.lists(v.single_draws(s, d)).withColumn("source", F.lit("a"))


def _linked(s, d):
    return wn.link(v.winners(s, d), _singles(s, d), ["a"])


def _merge(s, d):
    """A second sight of every fourth draw: figures that it lacks stay, and so does the first time."""
    e = _singles(s, d).withColumns({"fetched_at": F.lit("2024-01-01").cast("timestamp")}).select("game", "draw_number", "source", "jackpot_cents", "wins", "fetched_at")
    later = F.lit("2024-02-01").cast("timestamp")
    new = e.filter("draw_number % 4 = 0").withColumns({"fetched_at": later, "jackpot_cents": F.when(F.col("draw_number") % 8 == 0, F.col("jackpot_cents") + 1), "wins": F.col("wins") + 1})
    return sinks.merge_draws(e, new).withColumn("fetched_at", F.to_date("fetched_at"))


def _merge_winners(s, d):
    w = v.winners(s, d).withColumns({"source": F.lit("a"), "source_url": F.lit("u"), "fetched_at": F.lit("2024-01-01").cast("timestamp")}).withColumn("location_raw", F.col("id").cast("string"))
    first = wn.announcements(w).select([c.split()[0] for c in sinks.WINNERS.split(", ")])
    again = first.withColumns({"fetched_at": F.lit("2024-02-01").cast("timestamp"), "players": F.lit(2), "draw_number": F.lit(None).cast("long")})
    return sinks.merge_winners(first, again).select(F.col("location_raw").cast("long").alias("id"), "game", "draw_number", "players", F.to_date("fetched_at").alias("fetched"))


def _months(s, d):
    games = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("game")).distinct().withColumn("first_year", F.lit(2020))
    return sinks.months_to_fetch(games, v.ingest_log(s, d), "a", F.lit("2024-05-20").cast("date"))


def _estimates(s, d):
    e = v.single_draws(s, d).select("game", "draw_number", F.lit("current").alias("kind"), "jackpot_cents", F.lit("a").alias("source"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"))
    new = e.filter("draw_number % 3 = 0").withColumns({"jackpot_cents": F.col("jackpot_cents") + 5, "fetched_at": F.lit("2024-02-01").cast("timestamp")})
    return sinks.merge_last(e, new, ["game", "draw_number", "kind"]).drop("fetched_at")


def _markers(s, d):
    w = v.winners(s, d)
    m = wn.place_markers(w, wn.locations(w, v.gazetteer(s)))
    return m.select("place", "label", "lat", "lon", "count", "amount_cents", F.size("outlets").alias("outlets"), F.to_json("games").alias("games"))


def _nested(s, d):
    w = v.winners(s, d)
    n = wn.nested(w, wn.locations(w, v.gazetteer(s)))
    said = F.array_join(F.transform("outlets", lambda o: F.concat_ws("@", o["outlet"], o["place"])), ";")
    return n.select("id", "game", F.size("outlets").alias("n"), said.alias("outlets"))


def _placed(s, d):
    k = s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") % 97 / 100 + 10.2).alias("lat"), (F.col("s_suppkey") % 89 / 100 - 61.5).alias("lon"), (F.col("s_suppkey") % 13 + 1).alias("count"))
    return fm.placed(k, fm.Projection(-61.5, 10.0, -60.9, 10.8, 12, 28, 590, 478), fm.Projection(-60.9, 11.0, -60.5, 11.4, 630, 40, 176, 132)).drop("lat", "lon")


_K1, _K2 = "cos(radians(10.4))", "cos(radians(11.2))"
_S1, _S2 = f"least(590 / (0.624 * {_K1}), 478 / 0.832)", f"least(176 / (0.416 * {_K2}), 132 / 0.416)"
PLACED = f"""WITH k AS (SELECT s_suppkey, s_suppkey % 97 / 100 + 10.2 AS lat, s_suppkey % 89 / 100 - 61.5 AS lon, s_suppkey % 13 + 1 AS count FROM supplier),
  t AS (SELECT *, (lon BETWEEN -60.908 AND -60.492 AND lat BETWEEN 10.992 AND 11.408)
      OR (NOT (lon BETWEEN -61.512 AND -60.888 AND lat BETWEEN 9.984 AND 10.816) AND lat > 11.0) AS inset FROM k)
  SELECT s_suppkey, count,
    round_even(CASE WHEN inset THEN (lon + 60.908) * {_K2} * {_S2} + 630 + (176 - 0.416 * {_K2} * {_S2}) / 2 ELSE (lon + 61.512) * {_K1} * {_S1} + 12 + (590 - 0.624 * {_K1} * {_S1}) / 2 END * 10, 0) / 10 AS x,
    round_even(CASE WHEN inset THEN (11.408 - lat) * {_S2} + 40 + (132 - 0.416 * {_S2}) / 2 ELSE (10.816 - lat) * {_S1} + 28 + (478 - 0.832 * {_S1}) / 2 END * 10, 0) / 10 AS y,
    round_even((4.5 + 11 * pow(count / (SELECT max(count) FROM k), 0.6)) * 10, 0) / 10 AS r FROM t"""


def _formats(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.rint(F.col("o_totalprice") * 100).cast("long").alias("c"))
    big = F.when(F.col("o_orderkey") % 3 == 0, F.col("c") * 1000).when(F.col("o_orderkey") % 3 == 1, F.col("c")).otherwise(F.col("c") % 90_000)
    p = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey") % 1000 / 1000)
    return o.select("o_orderkey", fm.money(big).alias("money"), fm.p_value(p).alias("p"), fm.verdict(p, p * 2).alias("verdict"))


def _texts(s, d):
    """Times, periods, headers, lists and thousandths read from texts made of orders."""
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    h, m = F.col("o_orderkey") % 30, F.col("o_orderkey") % 60
    time = F.format_string("%d:%02d %s", F.when(h > 12, h - 12).otherwise(h), m, F.when(h > 12, "PM").otherwise("am"))
    text = F.format_string("%d-%d|%d, x9 %d", h, m, h, F.col("o_orderkey") % 2000)
    clock = parse.clock(time)
    return o.select(
        "o_orderkey", clock.alias("clock"), parse.period(clock).alias("period"), F.array_join(F.transform(parse.numbers(text), lambda x: x.cast("string")), "-").alias("numbers"),
        parse.cents_of_thousandths(F.concat(F.col("o_orderkey").cast("string"), F.lit("5"))).alias("cents"), parse.winner_date(F.concat(F.date_format("day", "EEEE d"), F.lit("th "), F.date_format("day", "MMMM, yyyy")), F.lit("2024-01-01").cast("date")).alias("won"),
        parse.either_date(F.date_format("day", "d-M-yyyy"), F.col("day")).alias("dashed"), parse.either_date(F.date_format("day", "yyyy/M/d"), F.lit(None).cast("date")).alias("year_first"),
    )


TEXTS = """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 30 AS h, o_orderkey % 60 AS m FROM orders),
  t AS (SELECT *, CASE WHEN h > 12 AND h - 12 > 12 THEN CASE WHEN h - 12 + 12 <= 23 THEN h - 12 + 12 END WHEN h > 12 THEN CASE WHEN h = 24 THEN 12 ELSE h END WHEN h = 12 THEN 0 ELSE h END AS hh FROM o)
  SELECT o_orderkey, CASE WHEN hh <= 23 THEN printf('%02d:%02d', hh, m) END AS clock,
    CASE WHEN hh < 12 THEN 'Morning' WHEN hh < 15 THEN 'Midday' WHEN hh < 18 THEN 'Afternoon' WHEN hh <= 23 THEN 'Evening' END AS period,
    concat_ws('-', h, m, h, CASE WHEN o_orderkey % 2000 < 1000 THEN o_orderkey % 2000 END) AS numbers, CAST(round_even((o_orderkey * 10 + 5) / 10, 0) AS BIGINT) AS cents, day AS won, day AS dashed, day AS year_first FROM t"""


def _runs(s, d):
    return fits.runs_test(v.single_draws(s, d), F.col("number") >= 50).withColumn("z", F.round("z", 6))


def _gaps(s, d):
    return fits.gap_test(v.lists(v.single_draws(s, d)).withColumn("numbers", F.array(F.col("number") % 20)), 17, 20).select("game", "gaps", F.round("mean_gap", 6).alias("mean_gap"), F.round("ks", 6).alias("ks"))


def _stretched(s, d):
    """Numbers of draws in order, as the windows of the sequence tests see them."""
    return sequence(v.single_draws(s, d)).select("game", "draw_number", F.col("nth").cast("long").alias("nth"), "n")


def _meta(s, d):
    x = dr.load_draws(v.two_lists(s, d), ["a", "b"])
    none = s.createDataFrame([], "game string, era int, label string, pool_min int, pool_max int, first long, last long")
    return dr.game_meta(x, v.games(s, d), none).select("game", "pool_min", "pool_max", "picks", "draws", "has_jackpot", "note")


def _eras(s, d):
    return dr.pool_eras(v.lists(v.era_draws(s, d))).select("game", "era", "label", "pool_min", "pool_max", "first", "last")


def queries(d1: str, d2: str) -> dict:
    """{name: (query, its SQL or None)}; d1 and d2 are the SQL of the single draws and of both sources."""
    two = lambda f: lambda s, d: f(v.two_lists(s, d))
    one = lambda f: lambda s, d: f(_singles(s, d))
    log = lambda f: lambda s, d: f(v.ingest_log(s, d))
    won = lambda f: lambda s, d: f(v.winners(s, d))
    return {
        "load_draws": (
            two(lambda x: _as_text(dr.load_draws(x, ["a", "b"])).select("game", "draw_number", "draw_date", "numbers", "jackpot_cents", "draw_time", "source")),
            f"WITH {d2}{MERGED} SELECT game, draw_number, draw_date, CAST(numbers[1] AS TEXT) AS numbers, jackpot_cents, draw_time, source FROM ld",
        ),
        "placeholders": (two(sv.placeholders), f"WITH {d2}{L2} SELECT game, source, count(*) AS n FROM l2 WHERE numbers = [0] GROUP BY ALL"),
        "game_meta": (
            _meta,
            f"""WITH {d2}{MERGED}, c AS (SELECT game, numbers[1] AS x, count(*) AS c FROM ld GROUP BY ALL), p AS (SELECT game, coalesce(min(x) FILTER (c >= 3), min(x)) AS lo, coalesce(max(x) FILTER (c >= 3), max(x)) AS hi, CAST(sum(c) AS BIGINT) AS draws FROM c GROUP BY game)
              SELECT game, lo AS pool_min, hi AS pool_max, 1 AS picks, draws, true AS has_jackpot, CASE WHEN lo <> 0 OR hi <> 99 THEN concat('main pool ', lo, '-', hi, ' in the data, declared 0-99') END AS note FROM p""",
        ),
        "pool_eras": (_eras, None),
        "sequence": (
            _stretched,
            f"""WITH {d1} SELECT game, draw_number, row_number() OVER (PARTITION BY game
              ORDER BY draw_date, draw_number) AS nth, count(*) OVER (PARTITION BY game) AS n
              FROM d1""",
        ),
        "runs_test": (
            _runs,
            f"""WITH {d1}, x AS (SELECT game, CAST(number >= 50 AS INT) AS f, lag(CAST(number >= 50 AS INT)) OVER (PARTITION BY game ORDER BY draw_date, draw_number) AS g FROM d1),
              y AS (SELECT game, count(*) AS n, count(*) FILTER (f IS DISTINCT FROM g) AS runs, 2.0::DOUBLE * sum(f) * sum(1 - f) AS b FROM x GROUP BY game)
              SELECT game, n, runs, round((runs - b / n - 1) / sqrt(b * (b - n) / (n * n * (n - 1))), 6) AS z FROM y WHERE n >= 20 AND b > 0""",
        ),
        "gap_test": (
            _gaps,
            f"""WITH {d1}, q AS (SELECT game, number % 20 AS number, row_number() OVER (PARTITION BY game ORDER BY draw_date, draw_number) AS nth FROM d1), g AS (SELECT game, nth - lag(nth) OVER (PARTITION BY game ORDER BY nth) AS gap FROM q WHERE number = 17),
              h AS (SELECT game, gap, count(*) AS c FROM g WHERE gap IS NOT NULL GROUP BY ALL), u AS (SELECT *, sum(c) OVER (PARTITION BY game ORDER BY gap) AS upto, sum(c) OVER (PARTITION BY game) AS n, 1 - pow(0.95::DOUBLE, gap) AS law FROM h)
              SELECT game, CAST(max(n) AS BIGINT) AS gaps, round(sum(gap * c) / max(n), 6) AS mean_gap, round(max(greatest(upto / n - law, law - (upto - c) / n)), 6) AS ks FROM u GROUP BY game HAVING max(n) >= 30""",
        ),
        "totals": (
            two(lambda x: sv.totals(x)),
            f"WITH {d2} SELECT count(*) AS rows, count(DISTINCT game) AS games, min(draw_date) AS first_date, max(draw_date) AS last_date FROM d2",
        ),
        "winner_totals": (won(sv.winner_totals), f"WITH {d1}{W1} SELECT count(*) AS winners, CAST(sum(amount_cents) AS BIGINT) AS amount_cents FROM w1"),
        "recent_draws": (
            one(lambda x: sv.recent(x, 12, "p").select("game", "draw_number", "draw_date")),
            f"WITH {d1} SELECT game, draw_number, draw_date FROM d1 WHERE game NOT LIKE 'p%' ORDER BY draw_date DESC, draw_number DESC, game LIMIT 12",
        ),
        "games_with_coverage": (
            lambda s, d: sv.games_with_coverage(v.games(s, d), _singles(s, d), ["view", "click"]).select("code", "pool_max", "draws", "first_date", "last_date", "place"),
            f"""WITH {d1} SELECT game AS code, 99 AS pool_max, count(DISTINCT draw_number) AS draws, min(draw_date) AS first_date, max(draw_date) AS last_date, CASE game WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS place
              FROM d1
              GROUP BY game""",
        ),
        "overlap": (two(lambda x: sv.overlap(x, "a", "b")), f"WITH {d2} SELECT game, count(*) AS n FROM two GROUP BY game"),
        "conflict_rows": (
            two(lambda x: sv.conflicts(x, "a", "b").select("game", "draw_number", F.get("official", F.lit(0)).alias("official"), F.get("mirror", F.lit(0)).alias("mirror"))),
            f"""WITH {d2}{L2} SELECT a.game, a.draw_number, a.numbers[1] AS official, b.numbers[1] AS mirror
              FROM l2 a JOIN l2 b USING (game, draw_number)
              WHERE a.source = 'a' AND b.source = 'b' AND a.numbers <> b.numbers
              ORDER BY 1, 2 LIMIT 300""",
        ),
        "page_rows": (
            one(lambda x: sv.page(x, "view", 3, "1")[0].select("draw_number", "draw_date", "number")),
            f"""WITH {d1} SELECT draw_number, draw_date, number
              FROM d1
              WHERE game = 'view' AND (CAST(draw_number AS TEXT) LIKE '%1%' OR CAST(draw_date AS TEXT) LIKE '%1%' OR CAST([number] AS TEXT) LIKE '%1%')
              ORDER BY draw_date DESC, draw_number DESC LIMIT 50 OFFSET 100""",
        ),
        "page_count": (
            one(lambda x: sv.page(x, "view", 1, "17")[1]),
            f"""WITH {d1} SELECT count(*) AS rows, CAST(ceil(count(*) / 50) AS BIGINT) AS pages
              FROM d1
              WHERE game = 'view' AND (CAST(draw_number AS TEXT) LIKE '%17%' OR CAST(draw_date AS TEXT) LIKE '%17%' OR CAST([number] AS TEXT) LIKE '%17%')""",
        ),
        "api_draws": (
            two(lambda x: sv.api_draws(x, "view", 9000).select("draw_number", "draw_date", "source", "jackpot_cents")),
            f"""WITH {d2} SELECT draw_number, draw_date, source, jackpot_cents
              FROM d2
              WHERE game = 'view'
              ORDER BY draw_date DESC, draw_number DESC, source LIMIT 5000""",
        ),
        "per_year": (
            lambda s, d: sv.per_year(v.set_draws(s, d)),
            """WITH x AS (SELECT l_orderkey
              FROM lineitem
              GROUP BY 1
              HAVING count(DISTINCT l_linenumber) = 3) SELECT o_orderpriority AS game, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n
              FROM x JOIN orders ON l_orderkey = o_orderkey
              GROUP BY ALL""",
        ),
        "ingest_summary": (log(sv.ingest_summary), f"WITH {LG} SELECT source, status, count(*) AS n, max(ts) AS last FROM lg GROUP BY ALL"),
        "last_errors": (log(sv.last_errors), f"WITH {LG} SELECT source, target, note, ts FROM lg WHERE status = 'error' ORDER BY ts DESC, source, target LIMIT 25"),
        "last_runs": (log(lambda x: sv.runs(x.select(F.to_date("ts").alias("run_ts")))), f"WITH {LG} SELECT DISTINCT CAST(ts AS DATE) AS run_ts FROM lg ORDER BY 1 DESC LIMIT 20"),
        "months_to_fetch": (
            _months,
            f"""WITH {LG}, m AS (SELECT event_type AS game, unnest(generate_series(DATE '2020-01-01', DATE '2024-05-01', INTERVAL 1 MONTH))::DATE AS m FROM (SELECT DISTINCT event_type FROM events)),
              t AS (SELECT game, m, concat(game, ':', year(m), '-', strftime(m, '%b')) AS target FROM m)
              SELECT game, CAST(year(m) AS INT) AS year, CAST(month(m) AS INT) AS month, target FROM t WHERE m >= DATE '2024-04-01' OR target NOT IN (SELECT target FROM lg WHERE source = 'a' AND status = 'ok')""",
        ),
        "link_winners": (
            lambda s, d: _linked(s, d).select("id", "draw_number", "draw_date", "match_method"),
            f"WITH {d1}{LINK} SELECT id, draw_number, draw_date, match_method FROM lk",
        ),
        "winner_consistency": (
            lambda s, d: wn.consistency(wn.one_draw_each(_linked(s, d), _singles(s, d), ["a"])),
            f"""WITH {d1}{LINK}, j AS (SELECT lk.*, d1.draw_date AS dd, d1.number AS dn FROM lk JOIN d1 ON d1.game = lk.game AND d1.draw_number = lk.draw_number)
              SELECT count(*) AS checked, count(*) FILTER (strftime(dd, '%d/%m/%Y') <> draw_date_raw AND strftime(dd, '%m/%d/%Y') <> draw_date_raw) AS dates, count(*) FILTER (number <> dn) AS numbers FROM j""",
        ),
        "location_rows": (won(lambda w: wn.location_rows(w, wn.locations(w))), f"WITH {d1}{OUT} SELECT w1.game, outlet, area FROM o JOIN w1 ON w1.id = o.winner_id"),
        "winners_nested": (
            _nested,
            f"""WITH {d1}{MAPPED}, q AS (SELECT winner_id, count(*) AS n, string_agg(concat_ws('@', outlet, CASE WHEN place IS NOT NULL THEN area END), ';'
              ORDER BY seq) AS outlets
              FROM m
              GROUP BY ALL) SELECT id, game, CAST(coalesce(n, 0) AS INT) AS n, coalesce(outlets, '') AS outlets
              FROM w1
              LEFT JOIN q ON winner_id = id""",
        ),
        "place_markers": (
            _markers,
            f"""WITH {d1}{MAPPED}, x AS (SELECT m.*, w1.game, w1.amount_cents FROM m JOIN w1 ON w1.id = m.winner_id WHERE m.place IS NOT NULL),
              g AS (SELECT area, string_agg(concat('"', game, '":', c), ',' ORDER BY game) AS g FROM (SELECT area, game, count(*) AS c FROM x GROUP BY ALL) GROUP BY area)
              SELECT area AS place, area AS label, 10.0 + (list_position({PLACES}, area) - 1) / 8 AS lat, -61.0 - (list_position({PLACES}, area) - 1) / 4 AS lon, count(*) AS count, CAST(sum(amount_cents) AS BIGINT) AS amount_cents,
                CAST(count(DISTINCT outlet) AS INT) AS outlets, concat('{{', any_value(g), '}}') AS games FROM x JOIN g USING (area) GROUP BY area""",
        ),
        "merge_draws": (
            _merge,
            f"""WITH {d1} SELECT game, draw_number, 'a' AS source, CASE WHEN draw_number % 8 = 0 THEN jackpot_cents + 1 ELSE jackpot_cents END AS jackpot_cents, CASE WHEN draw_number % 4 = 0 THEN wins + 1 ELSE wins END AS wins, DATE '2024-01-01' AS fetched_at
              FROM d1""",
        ),
        "merge_estimates": (
            _estimates,
            f"""WITH {d1} SELECT game, draw_number, 'current' AS kind, CASE WHEN draw_number % 3 = 0 THEN jackpot_cents + 5 ELSE jackpot_cents END AS jackpot_cents, 'a' AS source
              FROM d1""",
        ),
        "merge_winners": (_merge_winners, f"WITH {d1}{W1} SELECT id, game, draw_number, 2 AS players, DATE '2024-01-01' AS fetched FROM w1"),
        "map_points": (_placed, PLACED),
        "formats": (
            _formats,
            """WITH o AS (SELECT o_orderkey, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS c FROM orders), b AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN c * 1000 WHEN 1 THEN c ELSE c % 90000 END AS c, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 1000 / 1000 END AS p FROM o)
              SELECT o_orderkey, concat('$', format('{:,.2f}', c / 100)) AS money, CASE WHEN p IS NULL THEN '-' ELSE printf('%.4f', p) END AS p, CASE WHEN p IS NULL THEN 'descriptive' WHEN p * 2 < 0.05 THEN 'flagged' WHEN p < 0.05 THEN 'p under .05' ELSE 'consistent' END AS verdict FROM b""",
        ),
        "text_parsers": (_texts, TEXTS),
    }
