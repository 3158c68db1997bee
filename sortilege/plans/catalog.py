"""All queries of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import battery as bt
from ..operators import core as op
from ..operators import draws as dr
from ..operators import ranks
from ..operators import results as rs
from ..operators import serving as sv
from ..operators import winners as wn
from ..sources import views as v
from . import more, stores

D1 = """d1 AS (SELECT event_type AS game, event_id AS draw_number, CAST(ts AS DATE) AS draw_date, CAST(isodow(ts) - 1 AS INT) AS dow, CAST(hour(ts) AS INT) AS hour,
  CAST(json_extract_string(props, '$.k') AS INT) AS number, CAST(round_even(value * 100, 0) AS BIGINT) AS jackpot_cents, CAST(user_id % 10 = 0 AS INT) AS wins FROM events)"""
DK = """dk AS (SELECT o_orderpriority AS game, o_orderkey AS draw_number, CAST(o_orderdate AS DATE) AS draw_date, numbers, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS jackpot_cents
  FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS numbers FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey WHERE len(numbers) = 3)"""
D2 = D1 + """, d2 AS (SELECT * EXCLUDE (jackpot_cents), CASE WHEN draw_number % 5 <> 0 THEN jackpot_cents END AS jackpot_cents, 'a' AS source FROM d1
  UNION ALL BY NAME SELECT game, draw_number, draw_date, dow, hour, CASE WHEN draw_number % 7 = 0 THEN (number + 1) % 100 ELSE number END AS number,
    CASE WHEN draw_number % 11 = 0 THEN CAST(round_even(jackpot_cents * 1.5, 0) AS BIGINT) ELSE jackpot_cents END AS jackpot_cents, wins, 'b' AS source FROM d1 WHERE draw_number % 3 = 0),
  two AS (SELECT a.game, a.draw_number, a.number AS number_a, b.number AS number_b, a.jackpot_cents AS jackpot_a, b.jackpot_cents AS jackpot_b, a.draw_date AS date_a, b.draw_date AS date_b
    FROM d2 a JOIN d2 b ON a.game = b.game AND a.draw_number = b.draw_number WHERE a.source = 'a' AND b.source = 'b')"""
DE = D1 + """, de AS (SELECT game, draw_number, draw_date, nth, CASE WHEN nth * 3 > n AND nth * 3 <= n * 2 THEN number % 25 + 1 ELSE number % 20 + 1 END AS number
  FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY draw_date, draw_number) AS nth, count(*) OVER (PARTITION BY game) AS n FROM d1))"""
FREQ = """fr AS (SELECT game, number, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY game) / 100 AS expected
  FROM (SELECT game, number FROM (SELECT DISTINCT game FROM d1), (SELECT CAST(range AS INT) AS number FROM range(100))) LEFT JOIN (SELECT game, number, count(*) AS n FROM d1 GROUP BY ALL) USING (game, number))"""
FLOOR = """cut AS (SELECT game, quantile_cont(jackpot_cents, 0.4) AS p40, count(*) AS n FROM d1 WHERE jackpot_cents > 0 GROUP BY game HAVING count(*) >= 20),
  tail AS (SELECT game, jackpot_cents, count(*) AS c FROM d1 JOIN cut USING (game) WHERE jackpot_cents > 0 AND jackpot_cents <= p40 GROUP BY ALL),
  fl AS (SELECT game, CASE WHEN max(c) >= 0.15 * sum(c) THEN arg_min(jackpot_cents, (-c, jackpot_cents)) ELSE min(jackpot_cents) END AS floor_cents FROM tail GROUP BY game)"""
SEQ = FLOOR + """, sq AS (SELECT d1.*, floor_cents, coalesce(jackpot_cents <= floor_cents * 1.02, false) AS at_floor,
    lag(jackpot_cents) OVER w AS prev_jackpot, lead(jackpot_cents) OVER w AS next_jackpot
    FROM d1 LEFT JOIN fl USING (game) WHERE coalesce(jackpot_cents, 0) <> 0 WINDOW w AS (PARTITION BY game ORDER BY draw_date, draw_number))"""
INF = SEQ + """, inf AS (SELECT game, draw_number, draw_date, prev_jackpot, jackpot_cents AS this_jackpot, next_jackpot,
    CASE WHEN at_floor THEN 'at_jackpot_floor' WHEN next_jackpot / jackpot_cents < 0.9 THEN 'jackpot_drop' ELSE 'jackpot_drop_small' END AS method,
    CASE WHEN at_floor THEN 'undetermined' ELSE 'win' END AS verdict,
    CAST(CASE WHEN at_floor THEN 0.0 WHEN next_jackpot / jackpot_cents < 0.7 THEN 0.95 WHEN next_jackpot / jackpot_cents < 0.9 THEN 0.7 ELSE 0.35 END AS DOUBLE) AS confidence,
    wins AS published_wins,
    CASE WHEN wins IS NOT NULL AND NOT at_floor THEN CAST((wins > 0) = (next_jackpot / jackpot_cents < 0.9) AS INT) END AS agrees_with_published
    FROM sq WHERE next_jackpot IS NOT NULL AND (at_floor OR next_jackpot / jackpot_cents < 1))"""
CONFUSION = INF + """, have AS (SELECT * FROM sq WHERE wins IS NOT NULL),
  sc AS (SELECT h.game, h.wins, i.draw_number IS NOT NULL AS said FROM have h
    LEFT JOIN (SELECT * FROM inf WHERE verdict = 'win' AND confidence >= 0.6) i ON i.game = h.game AND i.draw_number = h.draw_number WHERE NOT h.at_floor),
  al AS (SELECT game, count(*) AS have, avg(CAST(wins > 0 AS INT)) AS won_rate FROM have GROUP BY game)
  SELECT game, count(*) AS scored, count(*) FILTER (said AND wins > 0) AS tp, count(*) FILTER (said AND wins = 0) AS fp,
    count(*) FILTER (NOT said AND wins > 0) AS fn, count(*) FILTER (NOT said AND wins = 0) AS tn, any_value(have) AS have, round(any_value(won_rate), 6) AS won_rate
  FROM sc JOIN al USING (game) GROUP BY game"""


def _rounded(df, *cols):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


def _contingency_sql(source: str, key: str, value: str) -> str:
    return f"""WITH {source}, c AS (SELECT game, {key} AS r, {value} AS c, count(*) AS n FROM __T__ GROUP BY ALL),
      r AS (SELECT game, r, sum(n) AS nr FROM c GROUP BY ALL), k AS (SELECT game, c, sum(n) AS nc FROM c GROUP BY ALL),
      t AS (SELECT game, sum(nr) AS t, count(*) AS kr FROM r GROUP BY ALL), u AS (SELECT game, count(*) AS kc FROM k GROUP BY ALL),
      g AS (SELECT *, nr * nc / t AS e, abs(coalesce(n, 0) - nr * nc / t) AS o FROM r JOIN k USING (game) JOIN t USING (game) JOIN u USING (game) LEFT JOIN c USING (game, r, c)),
      y AS (SELECT *, CASE WHEN kr = 2 AND kc = 2 THEN o - least(o, 0.5) ELSE o END AS z FROM g)
      SELECT game, round(sum(z * z / e), 6) AS chi2, CAST(max(t) AS BIGINT) AS n, max((kr - 1) * (kc - 1)) AS dof, round(sqrt(sum(z * z / e) / (max(t) * max(least(kr, kc) - 1))), 6) AS cramers_v FROM y GROUP BY game"""


def _parsed(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").filter("o_orderkey IS NOT NULL")
    t = o.select("o_orderkey", F.date_format("o_orderdate", "dd-MMM-yy").alias("a"), F.date_format("o_orderdate", "M/d/yyyy").alias("u"), F.to_date("o_orderdate").alias("day"), F.format_string("$%s", F.format_number(F.rint(F.col("o_totalprice") * 100) / 100, 2)).alias("m"))
    return t.select("o_orderkey", parse.archive_date(F.col("a")).alias("archive"), parse.either_date(F.col("u"), F.col("day")).alias("near"), parse.cents(F.col("m")).alias("cents"), parse.fingerprint(F.col("o_orderkey"), F.lit(None), F.col("day")).alias("print"))


def _upsert(s, d):
    e = v.single_draws(s, d).select("game", "draw_number", "jackpot_cents", "wins", F.lit(1).alias("version"))
    return op.upsert(e, e.filter("draw_number % 4 = 0").select("game", "draw_number", F.when(F.col("draw_number") % 8 == 0, F.col("jackpot_cents") + 1).alias("jackpot_cents"), (F.col("wins") + 1).alias("wins"), F.lit(2).alias("version")), ["game", "draw_number"], "version")


def _cards(s, d, part: str = "draw_number % 50 = 0"):
    return v.single_draws(s, d).filter(part).select(F.col("draw_number").alias("card_id"), "game", "number", F.when(F.col("draw_number") % 100 == 0, F.col("draw_date")).otherwise(F.date_add("draw_date", 400)).alias("card_date"))


def _findings(s, d):
    """All tests of all games and sources, winners too, with false-discovery control."""
    x = rs.Slices(v.archive(s, d), v.games(s, d), ["a", "b"], zero_games=["pick4"] + [r.code for r in v.games(s, d).filter("pool_min = 0").collect()])
    w = v.winners(s, d)
    others = [lambda: wn.winner_vs_draw(wn.link(w, x.rows, x.priority), x.rows, x.priority), lambda: wn.location_concentration(w, wn.locations(w))]
    return rs.run(x, others=others)


def _bh(s, d):
    p = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 != 0, (F.col("s_suppkey") * 37 % 101) / 101.0).alias("p_value"))
    return _rounded(op.benjamini_hochberg(p), "p_value", "q_value")


def _places(s, d):
    x = s.read.parquet(f"{d}/supplier.parquet").join(s.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    return x.groupBy(F.col("n_name").alias("place")).agg(F.count(F.lit(1)).alias("winners"), F.sum(F.rint(F.col("s_acctbal") * 100).cast("long")).alias("amount_cents"), F.countDistinct("s_name").alias("outlets"))


PLACES = ["ring", "small", "red widget", "widget", "blue", "bolt", "brand#1", "economy"]


def _quads(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("game"), F.transform(F.split(F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), ""), lambda x: x.cast("int")).alias("numbers"))


def _by_source(s, d):
    return v.set_draws(s, d).withColumn("source", F.when(F.col("draw_number") % 2 == 0, "a").otherwise("b"))


def _outlets(s, d):
    c, n = s.read.parquet(f"{d}/customer.parquet"), s.read.parquet(f"{d}/nation.parquet")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("game"), F.col("n_name").alias("outlet"))


def _eras(s, d):
    x = v.set_draws(s, d).select("game", "draw_date", F.explode("numbers").alias("number"))
    y = F.year("draw_date")
    return _rounded(op.contingency(x, F.concat((y - y % 3).cast("string"), F.lit("s"))), "chi2", "cramers_v")


_GRID_SQL = """x AS (SELECT {k}, b, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT {k}, sum(n) AS t, count(*) AS kinds, {size} AS size FROM x GROUP BY {k}),
  z AS (SELECT *, coalesce(n, 0) - t / size AS o, t / size AS e FROM (SELECT {k}, t, kinds, size, lo + CAST(unnest(range(size)) AS INT) AS b FROM t JOIN (SELECT {k}, {lo} AS lo FROM x GROUP BY {k}) USING ({k})) LEFT JOIN x USING ({k}, b))"""
_PLACE_SQL = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(upper({c}), '(^|[^A-Z0-9]){p.upper()}([^A-Z0-9]|$)') THEN '{p.upper()}' END" for c in ("p_type", "p_brand", "p_name") for p in sorted(PLACES, key=len, reverse=True)) + ")"


one = lambda f: lambda s, d: f(v.single_draws(s, d))
sets = lambda f: lambda s, d: f(v.set_draws(s, d))
two = lambda f: lambda s, d: f(v.two_sources(s, d))
_mean = "SELECT game, {} FROM {} GROUP BY game"
_COVER = "count(DISTINCT draw_number) AS draws, min(draw_date) AS first_date, max(draw_date) AS last_date, count(jackpot_cents) AS with_jackpot, count(wins) AS with_wins"

_ALL: dict = {
    "coverage": (one(op.coverage), f"WITH {D1} SELECT game, {_COVER} FROM d1 GROUP BY game"),
    "per_source_coverage": (two(lambda x: op.coverage(x, "game", "source")), f"WITH {D2} SELECT game, source, {_COVER} FROM d2 GROUP BY ALL"),
    "latest_draws": (
        one(lambda x: op.latest(x).select("game", "draw_number", "draw_date", "number")),
        f"WITH {D1} SELECT game, draw_number, draw_date, number FROM d1 ORDER BY draw_date DESC, draw_number DESC LIMIT 12",
    ),
    "search_page": (
        one(lambda x: op.search(x, "17", 2).select("game", "draw_number", "draw_date", "number")),
        f"""WITH {D1} SELECT game, draw_number, draw_date, number
          FROM d1
          WHERE CAST(draw_number AS TEXT) ILIKE '%17%' OR CAST(draw_date AS TEXT) ILIKE '%17%' OR CAST(number AS TEXT) ILIKE '%17%'
          ORDER BY draw_date DESC, draw_number DESC LIMIT 50 OFFSET 50""",
    ),
    "frequency_dense": (
        one(lambda x: _rounded(op.dense_frequency(x, 0, 99), "expected", "z")),
        f"WITH {D1}, {FREQ} SELECT game, number, n, round(expected, 6) AS expected, round((n - expected) / sqrt(expected * 0.99), 6) AS z FROM fr",
    ),
    "chi2_stat": (
        one(lambda x: _rounded(op.chi2_uniform(op.dense_frequency(x, 0, 99)), "chi2", "effect")),
        f"""WITH {D1}, {FREQ} SELECT game, CAST(sum(n) AS BIGINT) AS n, round(sum((n - expected) ** 2 / expected), 6) AS chi2, count(*) - 1 AS dof, round(max(abs(n - expected) / sqrt(expected * 0.99)), 6) AS effect
          FROM fr
          GROUP BY game""",
    ),
    "supported_range": (
        one(op.supported_range),
        f"""WITH {D1}, c AS (SELECT game, number, count(*) AS n
          FROM d1
          GROUP BY ALL) SELECT game, coalesce(min(number) FILTER (n >= 3), min(number)) AS low, coalesce(max(number) FILTER (n >= 3), max(number)) AS high
          FROM c
          GROUP BY game""",
    ),
    "pctl_median": (
        one(lambda x: _rounded(ranks.percentile(x, ["game"], "jackpot_cents", 0.5, "median").drop("n").join(ranks.percentile(x, ["game"], "jackpot_cents", 0.4, "p40").drop("n"), "game"), "median", "p40")),
        f"WITH {D1} " + _mean.format("round(quantile_cont(jackpot_cents, 0.5), 6) AS median, round(quantile_cont(jackpot_cents, 0.4), 6) AS p40", "d1"),
    ),
    "merge_sources": (
        two(lambda x: dr.load_draws(v.lists(x), ["a", "b"]).select("game", "draw_number", "draw_date", "number", "jackpot_cents", "wins", F.col("source").alias("sources"))),
        f"""WITH {D2}, k AS (SELECT * FROM d2 WHERE number <> 0) SELECT game, draw_number, arg_min(draw_date, source) AS draw_date, arg_min(number, source) AS number,
          arg_min(jackpot_cents, source) FILTER (jackpot_cents IS NOT NULL) AS jackpot_cents, arg_min(wins, source) AS wins, string_agg(DISTINCT source, '+' ORDER BY source) AS sources
          FROM k GROUP BY game, draw_number""",
    ),
    "conflicts": (
        two(lambda x: op.paired(x).filter("number_a <> number_b").select("game", "draw_number", "number_a", "number_b").orderBy("game", "draw_number").limit(300)),
        f"WITH {D2} SELECT game, draw_number, number_a, number_b FROM two WHERE number_a <> number_b ORDER BY game, draw_number LIMIT 300",
    ),
    "source_agreement": (
        two(op.agreement),
        f"""WITH {D2} SELECT game, count(*) AS shared, count(*) FILTER (number_a <> number_b) AS number_differs, count(*) FILTER (date_a <> date_b) AS date_differs
          FROM two
          GROUP BY game""",
    ),
    "money_ratio": (
        two(lambda x: _rounded(op.money_scale(x), "median_ratio", "share_near")),
        f"""WITH {D2} SELECT game, count(*) AS pairs, round(quantile_cont(jackpot_b / jackpot_a, 0.5), 6) AS median_ratio, round(avg(CAST(abs(jackpot_b / jackpot_a - 1) < 0.02 AS INT)), 6) AS share_near
          FROM two
          WHERE jackpot_a > 0 AND jackpot_b > 0
          GROUP BY game
          HAVING count(*) >= 5""",
    ),
    "pair_counts": (
        sets(op.pair_counts),
        f"""WITH {DK}, x AS (SELECT game, draw_number, unnest(numbers) AS n
          FROM dk) SELECT p.game, p.n AS a, q.n AS b, count(*) AS n
          FROM x p JOIN x q ON p.draw_number = q.draw_number AND p.n < q.n
          GROUP BY ALL""",
    ),
    "repeat_sets": (
        sets(op.repeat_sets),
        f"""WITH {DK}, c AS (SELECT game, numbers, count(*) AS n
          FROM dk
          GROUP BY ALL) SELECT game, CAST(sum(n) AS BIGINT) AS draws, count(*) AS kinds, CAST(sum(n - 1) AS BIGINT) AS repeats, max(n) AS most
          FROM c
          GROUP BY game""",
    ),
    "contingency_dow": (one(lambda x: _rounded(op.contingency(x, F.col("dow")), "chi2", "cramers_v")), _contingency_sql(D1, "dow", "number").replace("__T__", "d1")),
    "contingency_period": (
        one(lambda x: _rounded(op.contingency(x, F.col("hour") < 12), "chi2", "cramers_v")),
        _contingency_sql(D1, "hour < 12", "number").replace("__T__", "d1"),
    ),
    "won_low_number": (
        one(lambda x: _rounded(op.contingency(x.withColumn("low", F.col("number") <= 31), F.col("wins") > 0, "low"), "chi2", "cramers_v")),
        _contingency_sql(D1, "wins > 0", "number <= 31").replace("__T__", "d1"),
    ),
    "lag_overlap": (
        sets(op.lag_overlap),
        f"WITH {DK}" + "".join(f", l{k} AS (SELECT game, {k} AS lag, len(list_intersect(numbers, lag(numbers, {k}) OVER w)) AS o FROM dk WINDOW w AS (PARTITION BY game ORDER BY draw_date, draw_number))" for k in (1, 2, 3)) + " SELECT game, lag, CAST(sum(o) AS BIGINT) AS overlap, count(*) AS draws FROM (FROM l1 UNION ALL FROM l2 UNION ALL FROM l3) GROUP BY ALL",
    ),
    "consecutive": (
        sets(op.consecutive),
        f"WITH {DK} SELECT game, count(*) AS n, count(*) FILTER (numbers[2] - numbers[1] = 1 OR numbers[3] - numbers[2] = 1) AS hits FROM dk GROUP BY game",
    ),
    "positional": (
        sets(lambda x: x.select("game", F.posexplode("numbers").alias("pos", "number")).groupBy("game", "pos", "number").agg(F.count(F.lit(1)).alias("n"))),
        f"WITH {DK} SELECT game, CAST(i - 1 AS INT) AS pos, numbers[i] AS number, count(*) AS n FROM dk, (SELECT range AS i FROM range(1, 4)) GROUP BY ALL",
    ),
    "jackpot_floor": (one(op.jackpot_floor), f"WITH {D1}, {FLOOR} SELECT * FROM fl"),
    "inferred_wins": (one(op.inferred_wins), f"WITH {D1}, {INF} SELECT * FROM inf"),
    "undetermined_draws": (one(op.undetermined_draws), f"WITH {D1}, {SEQ} SELECT game, draw_number FROM sq WHERE at_floor"),
    "confusion": (one(lambda x: _rounded(op.confusion(x), "won_rate")), f"WITH {D1}, {CONFUSION}"),
    "published_vs_inferred": (
        one(lambda x: sv.published_vs_inferred(op.inferred_wins(x))),
        f"""WITH {D1}, {INF} SELECT game, count(*) AS n, count(*) FILTER (confidence >= 0.6) AS strong,
          CAST(sum(agrees_with_published) AS BIGINT) AS agree, count(agrees_with_published) AS checked FROM inf GROUP BY game""",
    ),
    "rollover_runs": (
        one(op.rollover_runs),
        f"""WITH {D1}, r AS (SELECT game, wins, coalesce(sum(wins) OVER (PARTITION BY game
          ORDER BY draw_date, draw_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
          FROM d1),
          c AS (SELECT game, run, count(*) AS length, max(wins) AS won
          FROM r
          GROUP BY ALL) SELECT game, length, count(*) AS runs
          FROM c
          WHERE won > 0
          GROUP BY ALL""",
    ),
    "cusum": (
        one(lambda x: _rounded(op.cusum(x), "magnitude")),
        f"""WITH {D1}, m AS (SELECT *, sum(number) OVER (PARTITION BY game) AS t, row_number() OVER w AS nth, sum(number) OVER w AS s, count(*) OVER (PARTITION BY game) AS n
          FROM d1 WINDOW w AS (PARTITION BY game
          ORDER BY draw_date, draw_number)) SELECT game, max(n) AS n, arg_max(nth, (abs(s * n - t * nth), -nth)) AS at, round(max(abs(s * n - t * nth)) / max(n) / sqrt(max(n)), 6) AS magnitude
          FROM m
          GROUP BY game
          HAVING max(n) >= 50""",
    ),
    "era_segments": (
        lambda s, d: op.era_segments(v.era_draws(s, d), 80),
        f"""WITH {DE}, t AS (SELECT *, max(number) OVER (PARTITION BY game
          ORDER BY nth ROWS BETWEEN 80 PRECEDING AND 80 FOLLOWING) AS top
          FROM de),
          c AS (SELECT *, CAST(top <> coalesce(lag(top) OVER (PARTITION BY game
          ORDER BY nth), -1) AS INT) AS fresh
          FROM t),
          g AS (SELECT *, sum(fresh) OVER (PARTITION BY game
          ORDER BY nth) AS segment
          FROM c) SELECT game, CAST(segment AS BIGINT) AS segment, max(top) AS top, CAST(min(nth) AS INT) AS first, CAST(max(nth) AS INT) AS last
          FROM g
          GROUP BY ALL""",
    ),
    "autocorr_stat": (
        one(lambda x: _rounded(op.autocorrelation(x), "r").drop("lag")),
        f"""WITH {D1}, l AS (SELECT game, number, lag(number) OVER (PARTITION BY game
          ORDER BY draw_date, draw_number) AS y
          FROM d1) SELECT game, count(*) AS pairs, round(corr(number, y), 6) AS r
          FROM l
          WHERE y IS NOT NULL
          GROUP BY game""",
    ),
    "out_of_pool": (
        one(lambda x: x.filter(~F.col("number").between(1, 90)).groupBy("game", "number").agg(F.count(F.lit(1)).alias("n"))),
        f"WITH {D1} SELECT game, number, count(*) AS n FROM d1 WHERE number NOT BETWEEN 1 AND 90 GROUP BY ALL",
    ),
    "bh_qvalues": (
        _bh,
        """WITH p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey * 37 % 101) / 101.0::DOUBLE END AS p_value
          FROM supplier),
          r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS m
          FROM p
          WHERE p_value IS NOT NULL),
          q AS (SELECT id, least(1.0, min(p_value * m / k) OVER (ORDER BY k DESC)) AS q_value
          FROM r) SELECT p.id, round(p.p_value, 6) AS p_value, round(q.q_value, 6) AS q_value
          FROM p
          LEFT JOIN q ON p.id = q.id""",
    ),
    "place_rollup": (
        _places,
        """SELECT n_name AS place, count(*) AS winners, CAST(sum(CAST(round_even(s_acctbal * 100, 0) AS BIGINT)) AS BIGINT) AS amount_cents, count(DISTINCT s_name) AS outlets
          FROM supplier JOIN nation ON s_nationkey = n_nationkey
          GROUP BY n_name""",
    ),
    "upsert_merge": (
        _upsert,
        f"""WITH {D1} SELECT game, draw_number, CASE WHEN draw_number % 8 = 0 THEN coalesce(jackpot_cents + 1, jackpot_cents) ELSE jackpot_cents END AS jackpot_cents, CASE WHEN draw_number % 4 = 0 THEN wins + 1 ELSE wins END AS wins, CAST(CASE WHEN draw_number % 4 = 0 THEN 2 ELSE 1 END AS INT) AS version
          FROM d1""",
    ),
    "parsers": (
        _parsed,
        """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS archive, CAST(o_orderdate AS DATE) AS near, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS cents, sha1(concat(o_orderkey, '||', CAST(o_orderdate AS DATE))) AS print
          FROM orders""",
    ),
    "best_match_link": (
        lambda s, d: op.best_match(_cards(s, d), v.single_draws(s, d)),
        f"""WITH {D1}, k AS (SELECT draw_number AS card_id, game, number, CASE WHEN draw_number % 100 = 0 THEN draw_date ELSE draw_date + 400 END AS card_date
          FROM d1
          WHERE draw_number % 50 = 0),
          j AS (SELECT card_id, d1.draw_number, card_date <> d1.draw_date AS other, row_number() OVER (PARTITION BY card_id
          ORDER BY card_date <> d1.draw_date, d1.draw_date, d1.draw_number) AS rn
          FROM k JOIN d1 USING (game, number)) SELECT card_id, draw_number, CASE WHEN other THEN 'numbers' ELSE 'numbers+date' END AS method
          FROM j
          WHERE rn = 1""",
    ),
    "best_match_all": (
        lambda s, d: op.best_match(_cards(s, d, "true"), v.single_draws(s, d)),
        f"""WITH {D1}, k AS (SELECT draw_number AS card_id, game, number, CASE WHEN draw_number % 100 = 0 THEN draw_date ELSE draw_date + 400 END AS card_date
          FROM d1),
          j AS (SELECT card_id, d1.draw_number, card_date <> d1.draw_date AS other, row_number() OVER (PARTITION BY card_id
          ORDER BY card_date <> d1.draw_date, d1.draw_date, d1.draw_number) AS rn
          FROM k JOIN d1 USING (game, number)) SELECT card_id, draw_number, CASE WHEN other THEN 'numbers' ELSE 'numbers+date' END AS method
          FROM j
          WHERE rn = 1""",
    ),
    "anti_done": (
        lambda s, d: v.single_draws(s, d).select("game", "draw_date").distinct().join(v.single_draws(s, d).filter("wins > 0").select("game", "draw_date").distinct(), ["game", "draw_date"], "left_anti"),
        f"WITH {D1} SELECT DISTINCT game, draw_date FROM d1 EXCEPT SELECT game, draw_date FROM d1 WHERE wins > 0",
    ),
    "positional_chi2": (
        sets(lambda x: _rounded(bt.positional_frequency(x, 1, 7), "chi2", "effect")),
        f"""WITH {DK}, c AS (SELECT game, CAST(i - 1 AS INT) AS pos, numbers[i] AS b
          FROM (SELECT game, numbers, unnest([1, 2, 3]) AS i
          FROM dk)), {_GRID_SQL.format(k='game, pos', size='7', lo='1')} SELECT game, pos, CAST(max(t) AS BIGINT) AS n, max(kinds) AS kinds, round(sum(o * o / e), 6) AS chi2, 6 AS dof, round(max(abs(o) / sqrt(e)), 6) AS effect
          FROM z
          GROUP BY game, pos""",
    ),
    "bonus_frequency": (
        one(lambda x: _rounded(bt.bonus_frequency(x, "hour"), "chi2", "effect")),
        f"""WITH {D1}, c AS (SELECT game, hour AS b
          FROM d1), {_GRID_SQL.format(k='game', size='max(b) - min(b) + 1', lo='min(b)')} SELECT game, 'hour' AS scope, 'bonus_frequency' AS test, CAST(max(t) AS BIGINT) AS n, round(sum(o * o / e), 6) AS chi2, max(size) - 1 AS dof, round(max(abs(o) / sqrt(e)), 6) AS effect
          FROM z
          GROUP BY game
          HAVING max(t) >= 100""",
    ),
    "bonus_flag": (
        one(lambda x: bt.bonus_frequency(x, "wins")),
        f"""WITH {D1} SELECT game, 'wins' AS scope, 'bonus_field_is_a_flag' AS test, count(*) AS n, CAST(NULL AS DOUBLE) AS chi2, CAST(NULL AS BIGINT) AS dof, CAST(NULL AS DOUBLE) AS effect
          FROM d1
          GROUP BY game
          HAVING count(*) >= 100""",
    ),
    "autocorr_lags": (
        one(lambda x: _rounded(op.autocorrelation(x, (1, 2, 3, 4, 5, 7, 10)), "r")),
        f"""WITH {D1}, l AS (SELECT *, row_number() OVER (PARTITION BY game
          ORDER BY draw_date, draw_number) AS nth
          FROM d1) SELECT a.game, k.lag, count(*) AS pairs, round(corr(a.number, b.number), 6) AS r
          FROM (SELECT unnest([1, 2, 3, 4, 5, 7, 10]) AS lag) k, l a JOIN l b ON a.game = b.game
          WHERE a.nth = b.nth + k.lag
          GROUP BY ALL""",
    ),
    "digit_tests": (
        lambda s, d: _rounded(bt.digit_tests(_quads(s, d)), "chi2"),
        """WITH q AS (SELECT o_orderpriority AS game, o_orderkey % 10000 AS x FROM orders), g AS (SELECT game, x % 10 AS a, x // 10 % 10 AS b, x // 100 % 10 AS c, x // 1000 AS d FROM q),
      n AS (SELECT game, count(*) AS n, count(*) FILTER (a = b AND b = c AND c = d) AS all_same, count(*) FILTER (a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d) AS all_distinct FROM g GROUP BY game),
      r AS (SELECT range AS i FROM range(10)), e AS (SELECT x.i + y.i + z.i + w.i AS s, count(*) / 10000 AS p FROM r x, r y, r z, r w GROUP BY 1), o AS (SELECT game, a + b + c + d AS s, count(*) AS o FROM g GROUP BY ALL)
      SELECT game, max(n) AS n, max(all_same) AS all_same, max(all_distinct) AS all_distinct, round(sum((coalesce(o, 0) - n * p) ** 2 / (n * p)), 6) AS chi2, count(*) - 1 AS dof FROM (SELECT * FROM n, e) LEFT JOIN o USING (game, s) WHERE n * p >= 5 GROUP BY game""",
    ),
    "rate_changepoint": (
        one(lambda x: _rounded(bt.rate_changepoints(x), "magnitude", "before", "after")),
        f"""WITH {D1}, o AS (SELECT game, number, row_number() OVER (PARTITION BY game ORDER BY draw_date, draw_number) AS nth, count(*) OVER (PARTITION BY game) AS n FROM d1),
      k AS (SELECT game, number AS ball, count(*) AS k FROM o GROUP BY ALL), s AS (SELECT game, ball, n, k, nth, CAST(sum(CAST(number = ball AS INT)) OVER (PARTITION BY game, ball ORDER BY nth) AS BIGINT) AS c FROM o JOIN k USING (game)),
      f AS (SELECT *, abs(c * n - k * nth) AS far FROM s), m AS (SELECT *, row_number() OVER (PARTITION BY game, ball ORDER BY far DESC, nth) AS first FROM f), t AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY far DESC, ball DESC) AS rank FROM m WHERE first = 1)
      SELECT game, CAST(rank AS INT) AS rank, ball AS number, nth AS at, round(far / n / sqrt(n), 6) AS magnitude, CASE WHEN nth > 1 THEN round(c / nth, 6) END AS before, CASE WHEN nth < n THEN round((k - c) / (n - nth), 6) END AS after FROM t WHERE rank <= 3 AND n >= 500""",
    ),
    "repeat_sets_by_source": (
        lambda s, d: _rounded(bt.repeat_sets_by_source(_by_source(s, d)), "expected"),
        f"""WITH {DK}, c AS (SELECT game, CASE WHEN draw_number % 2 = 0 THEN 'a' ELSE 'b' END AS source, numbers, count(*) AS c
          FROM dk
          GROUP BY ALL) SELECT game, source, CAST(sum(c) AS BIGINT) AS draws, CAST(sum(c - 1) AS BIGINT) AS repeats, round(sum(c) * (sum(c) - 1) / 2 / (factorial(max(numbers[3])::INT) / (6 * factorial(max(numbers[3])::INT - 3))), 6) AS expected
          FROM c
          GROUP BY ALL
          HAVING sum(c) >= 200""",
    ),
    "out_of_pool_examples": (
        one(lambda x: bt.examples_outside(x, 1, 90)),
        f"""WITH {D1} SELECT game, number, count(*) AS n, array_to_string(list(draw_number
          ORDER BY draw_date, draw_number)[1:4], ',') AS examples
          FROM d1
          WHERE number NOT BETWEEN 1 AND 90
          GROUP BY ALL""",
    ),
    "pool_calibration": (
        one(lambda x: bt.pool_calibration(x, 1, 90)),
        f"""WITH {D1}, c AS (SELECT game, number, count(*) AS n
          FROM d1
          GROUP BY ALL) SELECT game, 1 AS declared_low, 90 AS declared_high, coalesce(min(number) FILTER (n >= 3), min(number)) AS low, coalesce(max(number) FILTER (n >= 3), max(number)) AS high
          FROM c
          GROUP BY game
          HAVING low <> 1 OR high <> 90""",
    ),
    "location_concentration": (
        lambda s, d: bt.concentration(_outlets(s, d)),
        """WITH c AS (SELECT c_mktsegment AS game, n_name AS outlet, count(*) AS c
          FROM customer JOIN nation ON c_nationkey = n_nationkey
          GROUP BY ALL) SELECT game, CAST(sum(c) AS BIGINT) AS n, max(c) AS most, count(*) AS outlets, array_to_string(list(concat(outlet, ' x', c)
          ORDER BY c DESC, outlet)[1:3], ', ') AS top
          FROM c
          GROUP BY game
          HAVING sum(c) >= 5""",
    ),
    "match_place": (
        lambda s, d: bt.match_place(s.read.parquet(f"{d}/part.parquet"), PLACES, "p_type", "p_brand", "p_name").select("p_partkey", "place"),
        f"SELECT p_partkey, {_PLACE_SQL} AS place FROM part",
    ),
    "number_by_era": (
        _eras,
        _contingency_sql(DK + ", eras AS (SELECT game, concat(year(draw_date) - year(draw_date) % 3, 's') AS era, unnest(numbers) AS number FROM dk)", "era", "number").replace("__T__", "eras"),
    ),
    "downsample": (
        one(lambda x: bt.downsample(x, 900).select("game", "draw_number", "number")),
        f"""WITH {D1}, i AS (SELECT *, row_number() OVER (PARTITION BY game
          ORDER BY draw_date, draw_number) - 1 AS i, count(*) OVER (PARTITION BY game) AS n
          FROM d1) SELECT game, draw_number, number
          FROM i
          WHERE i % greatest(1, n // 900) = 0 OR i = n - 1""",
    ),
    "json_draws": (
        one(lambda x: bt.json_rows(x.select("game", "draw_number", "number"))),
        f"WITH {D1} SELECT CAST(to_json({{'game': game, 'draw_number': draw_number, 'number': number}}) AS TEXT) AS json FROM d1",
    ),
    "report_lines": (lambda s, d: bt.report_lines(_findings(s, d)), None),
    "findings": (_findings, None),
}
_ALL |= more.queries(D1, D2) | stores.queries(D1, D2)
QUERIES: dict = {k: f for k, (f, _) in _ALL.items()}
ORACLE_SQL: dict = {k: q for k, (_, q) in _ALL.items() if q}
