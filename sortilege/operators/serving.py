"""The questions that a site on the archive asks: overviews, pages, coverage, data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.format import verdict
from .core import coverage
from .draws import is_placeholder

PER_PAGE, MOST_ROWS, USUAL_ROWS = 50, 5000, 200


def totals(draws: DataFrame) -> DataFrame:
    return draws.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("game").alias("games"), F.min("draw_date").alias("first_date"), F.max("draw_date").alias("last_date"))


def winner_totals(winners: DataFrame) -> DataFrame:
    return winners.agg(F.count(F.lit(1)).alias("winners"), F.sum("amount_cents").alias("amount_cents"))


def recent(draws: DataFrame, n: int = 12, without: str = "") -> DataFrame:
    """The latest n draws of games whose code does not start with `without`."""
    d = draws.filter("draw_date IS NOT NULL")
    d = d.filter(~F.startswith("game", F.lit(without))) if without else d
    return d.orderBy(F.col("draw_date").desc(), F.col("draw_number").desc_nulls_last(), "game").limit(n)


def games_with_coverage(games: DataFrame, draws: DataFrame, order: Sequence[str]) -> DataFrame:
    """Games that have draws: those of `order` first, then the others by code; place counts from 1."""
    c = coverage(draws.filter("draw_number IS NOT NULL AND draw_date IS NOT NULL")).select(F.col("game").alias("code"), "draws", "first_date", "last_date")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("code")), F.lit(0)), F.lit(len(order) + 1)).cast("int")
    return games.join(F.broadcast(c), "code").withColumn("place", rank).orderBy("place", "code")


def placeholders(draws: DataFrame) -> DataFrame:
    return draws.filter(is_placeholder(F.col("numbers"))).groupBy("game", "source").agg(F.count(F.lit(1)).alias("n"))


def overlap(draws: DataFrame, a: str, b: str) -> DataFrame:
    side = lambda s: draws.filter(F.col("source") == s).select("game", "draw_number")
    return side(a).join(side(b), ["game", "draw_number"]).groupBy("game").agg(F.count(F.lit(1)).alias("n"))


def conflicts(draws: DataFrame, a: str, b: str, n: int = 300) -> DataFrame:
    """Draws of which two sources print different numbers, or the same in another order."""
    x = draws.filter(F.col("source") == a).select("game", "draw_number", "draw_date", F.col("numbers").alias("official"))
    y = draws.filter(F.col("source") == b).select("game", "draw_number", F.col("numbers").alias("mirror"))
    return x.join(y, ["game", "draw_number"]).filter(F.col("official") != F.col("mirror")).orderBy("game", "draw_number").limit(n)


def matching(text: str | None) -> Column:
    """Draws whose number, date or list of numbers holds the text; % and _ in it stand for any signs."""
    if not text:
        return F.lit(True)
    like = "%" + text.replace("\\", "\\\\") + "%"  # a backslash is a sign like others
    return F.col("draw_number").cast("string").ilike(like) | F.col("draw_date").cast("string").ilike(like) | F.col("numbers").cast("string").ilike(like)


def page(draws: DataFrame, game: str, number: int = 1, text: str | None = None, per: int = PER_PAGE) -> tuple[DataFrame, DataFrame]:
    """One page of a game's draws, newest first, and a row (rows, pages)."""
    hits = draws.filter((F.col("game") == game) & F.col("draw_number").isNotNull() & matching(text))
    newest = hits.orderBy(F.col("draw_date").desc_nulls_last(), F.col("draw_number").desc(), "source" if "source" in draws.columns else "draw_number")
    count = hits.agg(F.count(F.lit(1)).alias("rows")).withColumn("pages", F.ceil(F.col("rows") / per))
    return newest.offset(per * (max(1, number) - 1)).limit(per), count


def deep_page(draws: DataFrame, game: str, number: int = 1, text: str | None = None, per: int = PER_PAGE) -> DataFrame:
    """The rows of `page`, whatever its number, without a sort of the rows before it.

    Counts of each date tell on which dates the page lies and how many rows stand before these; only their rows are sorted.
    """
    hits = draws.filter((F.col("game") == game) & F.col("draw_number").isNotNull() & matching(text))
    before, after = per * (max(1, number) - 1), per * max(1, number)
    days = hits.groupBy("draw_date").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy(F.col("draw_date").desc_nulls_last()))  # one row for each date
    own = days.withColumn("upto", upto).filter((F.col("upto") > before) & (F.col("upto") - F.col("c") < after))
    first = own.agg(F.min(F.col("upto") - F.col("c")).alias("skipped"), F.min("draw_date").alias("a"), F.max("draw_date").alias("z"), F.max(F.col("draw_date").isNull().cast("int")).alias("dateless")).first()
    if first.skipped is None:
        return hits.limit(0)
    inside = F.coalesce(F.col("draw_date").between(F.lit(first.a), F.lit(first.z)), F.lit(bool(first.dateless))) if first.a is not None else F.col("draw_date").isNull()
    newest = hits.filter(inside).orderBy(F.col("draw_date").desc_nulls_last(), F.col("draw_number").desc(), "source" if "source" in draws.columns else "draw_number")
    return newest.offset(before - first.skipped).limit(per)


def api_draws(draws: DataFrame, game: str, limit: int = USUAL_ROWS) -> DataFrame:
    d = draws.filter(F.col("game") == game).orderBy(F.col("draw_date").desc_nulls_last(), F.col("draw_number").desc_nulls_last(), "source")
    return d.limit(max(0, min(limit, MOST_ROWS)))


def per_year(draws: DataFrame) -> DataFrame:
    return draws.filter("draw_date IS NOT NULL").groupBy("game", F.year("draw_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def ingest_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def last_errors(log: DataFrame, n: int = 25) -> DataFrame:
    return log.filter("status = 'error'").select("source", "target", "note", "ts").orderBy(F.col("ts").desc_nulls_last(), "source", "target").limit(n)


def runs(findings: DataFrame, n: int = 20) -> DataFrame:
    return findings.select("run_ts").distinct().orderBy(F.col("run_ts").desc()).limit(n)


def latest_findings(findings: DataFrame, game: str | None = None) -> DataFrame:
    """The last run's findings, strongest first, those without a test behind; with a verdict."""
    last = findings.agg(F.max("run_ts").alias("last_"))
    f = findings.join(F.broadcast(last), F.col("run_ts") == F.col("last_"), "left_semi")
    f = f.filter(F.col("game") == game) if game else f
    return f.withColumn("verdict", verdict(F.col("p_value"), F.col("q_value"))).orderBy(F.col("q_value").asc_nulls_last(), F.col("p_value").asc_nulls_last(), "game", "test", "scope")


def finding_counts(findings: DataFrame, level: float = 0.05) -> DataFrame:
    """tested, significant, descriptive, and the false positives that chance alone would give."""
    tested = F.count("p_value")
    return findings.agg(tested.alias("tested"), F.count_if(F.col("q_value") < level).alias("significant"), F.count_if(F.col("p_value").isNull()).alias("descriptive"), F.rint(tested * level).cast("long").alias("expected_false"))


def strongest(findings: DataFrame, n: int = 10, level: float = 0.05) -> DataFrame:
    return findings.filter(F.col("q_value") < level).orderBy("q_value", "p_value", "game", "test", "scope").limit(n)


def published_vs_inferred(inferred: DataFrame, level: float = 0.6) -> DataFrame:
    """Per game: draws that the rule marks, those it is sure of, those with a published count, and agreements."""
    return inferred.groupBy("game").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= level).alias("strong"), F.sum("agrees_with_published").alias("agree"), F.count("agrees_with_published").alias("checked"))


def bars(frequency: DataFrame) -> DataFrame:
    """Of counts (game, number, n, expected): z to two places, height as a share of the greatest count, and the hottest and coldest."""
    most = frequency.groupBy("game").agg(F.max("n").alias("most"), F.max_by("number", F.struct("n", -F.col("number"))).alias("hot"), F.min_by("number", F.struct("n", "number")).alias("cold"))
    z = F.when(F.col("expected") > 0, F.rint((F.col("n") - F.col("expected")) / F.sqrt("expected") * 100) / 100).otherwise(0.0)
    x = frequency.join(F.broadcast(most), "game")
    return x.select("game", "number", "n", z.alias("z"), F.try_divide(F.col("n"), F.col("most")).alias("height"), (F.col("number") == F.col("hot")).alias("hottest"), (F.col("number") == F.col("cold")).alias("coldest"))


def options(rows: DataFrame, column: str = "game") -> DataFrame:
    return rows.select(column).distinct().orderBy(column)


def row_filter(rows: DataFrame, text: str) -> DataFrame:
    """Rows of which any cell holds the text, whatever its case."""
    cells = F.lower(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]))
    return rows.filter(F.contains(cells, F.lit(text.lower())))
