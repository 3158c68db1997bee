"""Queries on paged sources, bucketed tables, indexes and shapes, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.format import Projection
from ..operators import postings, shapes
from ..operators import results as rs
from ..operators import serving as sv
from ..operators.sequence import sequence
from ..sources import buckets, paged, payloads, sinks
from ..sources import views as v
from ..sources.tables import shared_dir
from .more import MERGED

PER_PAGE = 250


def _folder(s, what: str) -> str:
    return f"{shared_dir(s)}/sortilege/{what}-{uuid.uuid4().hex}"


def _posts(s, d):
    """The draws as items of a web interface, numbered within each game."""
    e = sequence(v.single_draws(s, d))
    balls = F.struct(F.col("number").alias("number_1"), F.col("hour").alias("power_ball"))
    acf = F.to_json(F.struct(F.date_format("draw_date", "MM/dd/yyyy").alias("draw_date"), (F.col("jackpot_cents") * 10).alias("jackpot"), balls.alias("lotto_winning_numbers")))
    return e.select("game", "nth", F.col("draw_number").alias("id"), F.concat("draw_number", F.lit("-2")).alias("slug"), F.col("draw_date").cast("string").alias("date"), F.lit("link").alias("link"), acf.alias("acf"), "draw_date")


def _records(rows, game):
    r = payloads.records(paged.items(rows), "lotto", "web")
    return r.select(F.lit(game).alias("game"), "draw_number", "draw_date", F.get("numbers", F.lit(0)).alias("number"), "bonus_number", "jackpot_cents")


def _games(s, d):
    return [r[0] for r in s.read.parquet(f"{d}/events.parquet").select(F.col("event_type")).distinct().orderBy("event_type").collect()]


def _paged(s, d):
    """The draws written as pages and read back by the paged source, game by game."""
    path = _folder(s, "pages")
    paged.write_pages(_posts(s, d).withColumn("page", ((F.col("nth") - 1) / PER_PAGE + 1).cast("int")), path, "game")
    parts = [_records(paged.read(s, f"{path}/game={g}/page={{page}}", per_page=PER_PAGE), g) for g in _games(s, d)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _windowed(s, d):
    """Draws of each window and page of the listings by weeks."""
    path, first = _folder(s, "windows"), F.lit("2024-01-01").cast("date")
    posts = _posts(s, d).withColumn("after", F.date_add(first, (F.floor(F.datediff("draw_date", first) / 7) * 7).cast("int")))
    week = sequence(posts.drop("nth").withColumns({"kind": F.col("game"), "game": F.concat_ws("|", "game", "after"), "draw_number": F.col("id")}))
    week = week.withColumn("game", F.col("kind")).withColumn("page", ((F.col("nth") - 1) / PER_PAGE + 1).cast("int"))
    paged.write_pages(week, path, "game", "after")
    out = None
    for g in _games(s, d):
        rows = paged.read(s, f"{path}/game={g}/after={{after}}/page={{page}}", per_page=PER_PAGE, start="2024-01-01", end="2024-02-10")
        part = rows.filter("error IS NULL").groupBy(F.lit(g).alias("game"), "after", "page").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
        out = part if out is None else out.unionByName(part)
    return out


def _bucketed(s, d):
    """Three merges into a bucketed table: all draws, a later sight of a fourth of them, and a correction of a few."""
    e = v.single_draws(s, d).select("game", "draw_number", F.lit("a").alias("source"), "jackpot_cents", "wins", F.lit("2024-01-01").cast("timestamp").alias("fetched_at"))
    table = buckets.Buckets(s, _folder(s, "buckets"), e.schema, ["game", "draw_number", "source"], 16)
    at = lambda day: F.lit(day).cast("timestamp")
    table.merge(e, sinks.merge_draws)
    table.merge(e.filter("draw_number % 4 = 0").withColumns({"fetched_at": at("2024-02-01"), "jackpot_cents": F.when(F.col("draw_number") % 8 == 0, F.col("jackpot_cents") + 1), "wins": F.col("wins") + 1}), sinks.merge_draws)
    table.merge(e.filter("draw_number < 5").withColumns({"fetched_at": at("2024-03-01"), "wins": F.lit(9)}), sinks.merge_draws)
    return table.read().select("game", "draw_number", "jackpot_cents", "wins", F.to_date("fetched_at").alias("fetched"))


def _search(s, d):
    path = _folder(s, "postings")
    draws = v.two_lists(s, d)
    postings.build(draws, path)
    found = postings.search(draws, s.read.parquet(path), "4-01-1")
    return found.select("game", "draw_number", "source", F.get("numbers", F.lit(0)).alias("number"))


def _checked(s, d):
    """Results of the battery's own tests over the merged draws of both sources, through its runner; histories are not split."""
    x = rs.Slices(v.two_lists(s, d), v.games(s, d), ["a", "b"], zero_games=[])
    x.__dict__["eras"] = s.createDataFrame([], "game string, era int, label string, pool_min int, pool_max int, first long, last long")
    found = rs.run(x, ["source_agreement", "money_scale", "number_frequency", "by_dow", "pair_cooccurrence"])
    six = lambda c: F.round(F.col(c), 6).alias(c)
    return found.select("game", "test", "n", six("statistic"), "dof", six("effect"), "status")


BOX = Projection(-61.6, 10.1, -60.5, 11.2, 12, 28, 590, 478)


def _points(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", "c_nationkey", (F.col("c_custkey") * 37 % 101 / 100 - 61.5).alias("lon"), (F.col("c_custkey") * 53 % 97 / 100 + 10.15).alias("lat"))


def _shapes(s, d):
    """A ring for each nation, through the points of its customers in their order."""
    p = _points(s, d).groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "lon", "lat"))).alias("a"))
    return p.select(F.col("c_nationkey").alias("name"), F.array(F.transform("a", lambda x: F.array(x["lon"], x["lat"]))).alias("rings"))


def _paths(s, d):
    return _shapes(s, d).select("name", shapes.svg_path(F.array("rings"), BOX).alias("path"), F.size(F.get("rings", F.lit(0))).alias("points"))


def _within(s, d):
    k = s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") % 89 / 100 - 61.497).alias("lon"), (F.col("s_suppkey") % 83 / 100 + 10.153).alias("lat"))
    return shapes.within(k, _shapes(s, d)).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("name").alias("names"))


def _sql_xy() -> tuple[str, str]:
    lon0, lat0, lon1, lat1 = BOX.bounds
    k = f"cos(radians({(lat0 + lat1) / 2!r}::DOUBLE))"
    scale = f"least(590 / ({lon1 - lon0!r}::DOUBLE * {k}), 478 / {lat1 - lat0!r}::DOUBLE)"
    x = f"(lon - ({lon0!r}::DOUBLE)) * ({k} * {scale}) + 12 + (590 - {lon1 - lon0!r}::DOUBLE * {k} * {scale}) / 2"
    return x, f"({lat1!r}::DOUBLE - lat) * {scale} + 28 + (478 - {lat1 - lat0!r}::DOUBLE * {scale}) / 2"


X, Y = _sql_xy()
PT = "pt AS (SELECT c_custkey, c_nationkey, c_custkey * 37 % 101 / 100::DOUBLE - 61.5::DOUBLE AS lon, c_custkey * 53 % 97 / 100::DOUBLE + 10.15::DOUBLE AS lat FROM customer)"


def queries(d1: str, d2: str) -> dict:
    numbers = "CASE WHEN source = 'a' AND draw_number % 13 = 0 THEN 0 ELSE number END"
    return {
        "findings_checked": (
            _checked,
            f"""WITH {d2}{MERGED}, f AS (SELECT game, numbers[1] AS x, isodow(draw_date) AS w FROM ld),
            t AS (SELECT game, count(*) AS n FROM f GROUP BY game), c AS (SELECT game, x, count(*) AS c FROM f GROUP BY ALL),
            lim AS (SELECT game, min(x) AS lo, max(x) AS hi FROM c WHERE c >= 3 GROUP BY game),
            g AS (SELECT game, n, hi - lo + 1 AS size, n / (hi - lo + 1) AS e, coalesce(c, 0) AS c FROM (SELECT *, unnest(range(lo, hi + 1)) AS x FROM t JOIN lim USING (game)) LEFT JOIN c USING (game, x)),
            m AS (SELECT game, w, x, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT game, w, sum(n) AS nr FROM m GROUP BY ALL), k AS (SELECT game, x, sum(n) AS nc FROM m GROUP BY ALL),
            u AS (SELECT game, (SELECT count(*) FROM r WHERE r.game = t.game) AS kr, (SELECT count(*) FROM k WHERE k.game = t.game) AS kc, n FROM t),
            h AS (SELECT game, sum((coalesce(m.n, 0) - nr * nc / u.n) ** 2 / (nr * nc / u.n)) AS chi2 FROM r JOIN k USING (game) JOIN u USING (game) LEFT JOIN m USING (game, w, x) GROUP BY game),
            p AS (SELECT game, jackpot_a / jackpot_b AS q FROM two WHERE jackpot_a > 0 AND jackpot_b > 0)
            SELECT game, 'number_frequency' AS test, any_value(n) AS n, round(sum((c - e) ** 2 / e), 6) AS statistic, CAST(any_value(size) - 1 AS DOUBLE) AS dof, round(max(abs(c - e) / sqrt(e)), 6) AS effect, 'ok' AS status FROM g GROUP BY game
            UNION ALL SELECT game, 'number_by_dow', n, round(chi2, 6), CAST((kr - 1) * (kc - 1) AS DOUBLE), round(sqrt(chi2 / (n * (least(kr, kc) - 1))), 6), 'ok' FROM h JOIN u USING (game)
            UNION ALL SELECT game, 'source_agreement', count(*), CAST(count(*) FILTER (differs) AS DOUBLE), NULL, round(avg(CAST(differs AS INT)), 6), 'ok'
              FROM (SELECT game, CASE WHEN draw_number % 13 = 0 THEN 0 ELSE number_a END <> number_b AS differs FROM two) GROUP BY game
            UNION ALL SELECT game, 'money_scale_calibration', count(*), round(quantile_cont(q, 0.5), 6), NULL, round(avg(CAST(abs(q - 1) < 0.02 AS INT)), 6), 'ok' FROM p GROUP BY game HAVING count(*) >= 5""",
        ),
        "paged_draws": (_paged, f"WITH {d1} SELECT game, draw_number, draw_date, number, hour AS bonus_number, jackpot_cents FROM d1"),
        "windowed_draws": (
            _windowed,
            f"""WITH {d1}, w AS (SELECT game, draw_number, DATE '2024-01-01' + CAST(date_diff('day', DATE '2024-01-01', draw_date) // 7 * 7 AS INT) AS after, draw_date FROM d1),
            p AS (SELECT *, (row_number() OVER (PARTITION BY game, after ORDER BY draw_date, draw_number) - 1) // {PER_PAGE} + 1 AS page FROM w)
            SELECT game, CAST(after AS DATE) AS after, CAST(page AS INT) AS page, count(*) AS n, CAST(sum(draw_number) AS BIGINT) AS ids FROM p GROUP BY ALL""",
        ),
        "bucket_merges": (
            _bucketed,
            f"""WITH {d1} SELECT game, draw_number, CASE WHEN draw_number < 5 THEN jackpot_cents WHEN draw_number % 8 = 0 THEN jackpot_cents + 1 ELSE jackpot_cents END AS jackpot_cents,
            CAST(CASE WHEN draw_number < 5 THEN 9 WHEN draw_number % 4 = 0 THEN wins + 1 ELSE wins END AS INT) AS wins, DATE '2024-01-01' AS fetched FROM d1""",
        ),
        "deep_page": (
            lambda s, d: sv.deep_page(v.two_lists(s, d), "click", 23, None, 60).select("draw_number", "draw_date", "source"),
            f"WITH {d2} SELECT draw_number, draw_date, source FROM d2 WHERE game = 'click' ORDER BY draw_date DESC, draw_number DESC, source LIMIT 60 OFFSET 1320",
        ),
        "text_search": (
            _search,
            f"WITH {d2} SELECT game, draw_number, source, {numbers} AS number FROM d2 WHERE CAST(draw_number AS VARCHAR) LIKE '%4-01-1%' OR CAST(draw_date AS VARCHAR) LIKE '%4-01-1%'",
        ),
        "shape_paths": (
            _paths,
            f"WITH {PT} SELECT c_nationkey AS name, 'M' || string_agg(printf('%.2f,%.2f', {X}, {Y}), 'L' ORDER BY c_custkey) || 'Z' AS path, CAST(count(*) AS INT) AS points FROM pt GROUP BY 1",
        ),
        "points_in_shapes": (
            _within,
            f"""WITH {PT}, e AS (SELECT c_nationkey AS name, lon AS x0, lat AS y0, coalesce(lag(lon) OVER w, last_value(lon) OVER v) AS x1, coalesce(lag(lat) OVER w, last_value(lat) OVER v) AS y1
              FROM pt WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey), v AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
            k AS (SELECT s_suppkey, s_suppkey % 89 / 100::DOUBLE - 61.497::DOUBLE AS lon, s_suppkey % 83 / 100::DOUBLE + 10.153::DOUBLE AS lat FROM supplier),
            i AS (SELECT s_suppkey, name FROM k, e WHERE (y0 > lat) <> (y1 > lat) AND lon < x0 + (lat - y0) / (y1 - y0) * (x1 - x0) GROUP BY ALL HAVING count(*) % 2 = 1)
            SELECT s_suppkey, count(*) AS n, CAST(sum(name) AS BIGINT) AS names FROM i GROUP BY 1""",
        ),
    }
