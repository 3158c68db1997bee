"""A Markdown report as rows of lines: coverage, ranked results, what survives, descriptive checks, published against inferred wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.format import p_value


def _line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def _section(df: DataFrame, number: int, title: str, order: list, line: Column, head: str | None = None, empty: str | None = None) -> DataFrame:
    """Lines of one section; df has a few hundred rows at most, so one window spans it."""
    rows = df.select(F.row_number().over(Window.orderBy(*order)).alias("place"), line.alias("line"))
    above = [(-3, f"## {title}"), (-2, "")]
    if head:
        columns = head.split(", ")
        above += [(-1, "| " + " | ".join(columns) + " |"), (0, "|" + "---|" * len(columns))]
    fixed = df.sparkSession.createDataFrame(above, "place int, line string")
    if empty:
        none = df.agg(F.count(F.lit(1)).alias("c")).filter("c = 0").select(F.lit(1).alias("place"), F.lit(empty).alias("line"))
        rows = rows.unionByName(none)
    last = df.sparkSession.createDataFrame([(2_000_000_000, "")], "place int, line string")
    return fixed.unionByName(rows).unionByName(last).select(F.lit(number).alias("section"), "place", "line")


def report(findings: DataFrame, coverage: DataFrame, inferred: DataFrame, sims: int = 3000) -> DataFrame:
    """section, place, line of findings (results.run), coverage (core.coverage) and published_vs_inferred; for write.text once ordered by both."""
    p, q = p_value(F.col("p_value"), 2, "n/a"), p_value(F.col("q_value"), 2, "n/a")
    whole = lambda c: F.format_number(F.col(c), 0)
    stat = F.when(F.col("statistic").isNotNull(), F.format_string("%.3f", "statistic"))
    ranked = [F.col("q_value").asc_nulls_last(), F.col("p_value").asc_nulls_last(), "game", "test", "scope"]
    tested, name = findings.filter("p_value IS NOT NULL"), F.concat(F.lit("- **"), "game", F.lit(" / "), "test", F.lit(" ("), "scope", F.lit(")**: "))
    counts = findings.agg(F.count("p_value").alias("tested")).select(
        F.format_string("%d results have a p-value; about %d of these would lie under 0.05 if all draws were fair. q is the false-discovery rate over all of them. Simulated nulls have %d runs.", "tested", F.rint(F.col("tested") * 0.05).cast("int"), F.lit(sims)).alias("line")
    )
    cover = coverage.join(inferred.select("game", "n"), "game", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = _section(cover, 1, "Coverage", ["game"], _line(F.col("game"), whole("draws"), F.col("first_date"), F.col("last_date"), whole("with_jackpot"), whole("with_wins"), whole("n")), "game, draws, first, last, with jackpot, with wins, inferred")
    for part in (
        _section(counts, 2, "Reading", ["line"], F.col("line")),
        _section(tested, 3, "Results by evidence", ranked, _line(F.col("game"), F.col("test"), F.col("scope"), whole("n"), stat, p, q, F.col("detail")), "game, test, scope, n, statistic, p, q, detail"),
        _section(tested.filter("q_value < 0.05"), 4, "What survives", ranked, F.concat(name, F.lit("p="), p, F.lit(", q="), q, F.lit(". "), "detail"), empty="Nothing: all results are those of fair draws."),
        _section(findings.filter("p_value IS NULL"), 5, "Descriptive", ["game", "test", "scope"], F.concat(name, "detail"), empty="None."),
        _section(inferred, 6, "Wins inferred from jackpots", ["game"], _line(F.col("game"), whole("n"), whole("strong"), whole("checked"), F.coalesce("agree", F.lit(0))), "game, drops seen, sure, with a published count, agreed"),
    ):
        out = out.unionByName(part)
    return out
