"""Further tests of the battery, place matching, and report and JSON rows. All are for all games at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import supported_range
from .gazetteer import match_place  # noqa: F401
from .sequence import STRETCH, sequence


def chi2_counts(counts: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Uniform chi-square of counts n in `size` cells per keys; cells without a row count as zero."""
    g = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("kinds"), size.cast("long").alias("size"), F.max("n").alias("most"), F.min("n").alias("least"))
    e = F.col("total") / F.col("size")
    low = F.when(F.col("kinds") < F.col("size"), F.lit(0)).otherwise(F.col("least"))
    far = F.greatest(F.col("most") - e, e - low) / F.sqrt(e)
    return g.select(*keys, F.col("total").alias("n"), "kinds", (F.col("squares") / e - F.col("total")).alias("chi2"), (F.col("size") - 1).alias("dof"), far.alias("effect"))


def positional_frequency(draws: DataFrame, low: int, high: int) -> DataFrame:
    """Chi-square of the numbers low..high at each place of a draw."""
    c = draws.select("game", F.posexplode("numbers").alias("pos", "number")).filter(F.col("number").between(low, high))
    return chi2_counts(c.groupBy("game", "pos", "number").agg(F.count(F.lit(1)).alias("n")), ["game", "pos"], F.lit(high - low + 1))


def bonus_frequency(draws: DataFrame, bonus: str, least: int = 100) -> DataFrame:
    """Chi-square over the bonus values seen, least to greatest; fewer than three of them are a flag and not tested."""
    c = draws.filter(F.col(bonus).isNotNull()).groupBy("game", F.col(bonus).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    got = chi2_counts(c, ["game"], F.max("b") - F.min("b") + 1).filter(F.col("n") >= least)
    tested = lambda x: F.when(F.col("kinds") >= 3, F.col(x)).alias(x)
    name = F.when(F.col("kinds") >= 3, "bonus_frequency").otherwise("bonus_field_is_a_flag")
    return got.select("game", F.lit(bonus).alias("scope"), name.alias("test"), "n", tested("chi2"), tested("dof"), tested("effect"))


def digit_tests(draws: DataFrame) -> DataFrame:
    """Digit sums of four-digit draws against their exact distribution (cells of at least 5 expected), and draws of one or four different digits."""
    d = draws.filter(F.size("numbers") == 4)
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b.cast("int"))
    per = d.groupBy("game").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(F.array_distinct("numbers")) == 1).alias("all_same"), F.count_if(F.size(F.array_distinct("numbers")) == 4).alias("all_distinct"))
    quads = draws.sparkSession.range(10_000).select(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.floor(F.col("id") / F.pow(F.lit(10), i)) % 10).cast("int")).alias("q"))
    exact = quads.groupBy(total(F.col("q")).alias("s")).agg((F.count(F.lit(1)) / 10_000).alias("p"))
    seen = d.groupBy("game", total(F.col("numbers")).alias("s")).agg(F.count(F.lit(1)).alias("o"))
    grid = per.select("game", "n", F.explode(F.sequence(F.lit(0), F.lit(36))).alias("s")).join(exact, "s").join(seen, ["game", "s"], "left")
    e = F.col("n") * F.col("p")
    chi = grid.filter(e >= 5).groupBy("game").agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - e, 2) / e).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))
    return per.join(chi, "game", "left")


def rate_changepoints(draws: DataFrame, top: int = 3, least: int = 500) -> DataFrame:
    """The balls of draws of one number whose rate of appearance changes most, and where."""
    d = sequence(draws).filter(F.col("n") >= least).select("game", "number", "nth", "n")
    return peaks(d, top).drop("n")


def peaks(seq: DataFrame, top: int) -> DataFrame:
    """Of appearances (game, number, nth, n): the numbers whose centred running sum goes farthest from zero, and where.

    The sum over a number's 0/1 series peaks at one of its draws or just before
    one, so only these points are made, not a series for each number. Sums stay
    whole numbers (times the draws), so ties are exact: the first draw counts, and of
    numbers the greatest. A number's draws are counted by stretches of the sequence, and within each
    from the number of those before it.
    """
    x = seq.select("game", "number", "nth", "n", F.floor((F.col("nth") - 1) / STRETCH).alias("stretch"))
    per = x.groupBy("game", "number", "stretch").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("game", "number")  # one row for each stretch
    before = F.sum("c").over(w.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("game", "number", "stretch", F.coalesce(before, F.lit(0)).alias("before"), F.sum("c").over(w).alias("all"))
    own = F.row_number().over(Window.partitionBy("game", "number", "stretch").orderBy("nth"))
    d = x.withColumn("own", own).join(per, ["game", "number", "stretch"]).withColumn("k", F.col("before") + F.col("own")).drop("own", "before", "stretch")
    point = lambda nth, seen: F.struct(nth.alias("at"), seen.cast("long").alias("seen"))
    both = F.explode(F.array(point(F.col("nth"), F.col("k")), point(F.col("nth") - 1, F.col("k") - 1)))
    p = d.select("game", "number", "n", "all", both.alias("p")).select("game", "number", "n", "all", "p.*").filter("at > 0")
    far = F.abs(F.col("seen") * F.col("n") - F.col("all") * F.col("at"))
    b = p.groupBy("game", "number").agg(F.max(F.struct(far.alias("far"), (-F.col("at")).alias("neg"), "seen")).alias("m"), F.max("n").alias("n"), F.max("all").alias("all"))
    b = b.select("game", "number", "n", "all", F.col("m.far").alias("far"), (-F.col("m.neg")).alias("at"), F.col("m.seen").alias("seen"))
    order = Window.partitionBy("game").orderBy(F.col("far").desc(), F.col("number").desc())  # one row for each number of a pool
    b = b.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    before = F.when(F.col("at") > 1, F.col("seen") / F.col("at"))
    after = F.when(F.col("at") < F.col("n"), F.try_divide(F.col("all") - F.col("seen"), F.col("n") - F.col("at")))
    return b.select("game", "n", "rank", "number", "at", (F.col("far") / F.col("n") / F.sqrt("n")).alias("magnitude"), before.alias("before"), after.alias("after"))


def repeat_sets_by_source(draws: DataFrame, least: int = 200) -> DataFrame:
    """Repeated sets of each source against the expected number of equal pairs; only draws of three or more different numbers."""
    d = draws.filter(F.col("draw_number").isNotNull())
    kinds = d.groupBy("game", "source", F.array_sort("numbers").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    g = kinds.groupBy("game", "source").agg(F.sum("c").alias("draws"), F.sum(F.col("c") - 1).alias("repeats"), F.max(F.array_max("s")).alias("pool"), F.min(F.size("s")).alias("k"), F.bool_and(F.size(F.array_distinct("s")) == F.size("s")).alias("sets"))
    ways = F.aggregate(F.sequence(F.lit(1), F.col("k")), F.lit(1.0), lambda a, i: a * (F.col("pool") - F.col("k") + i) / i)
    return g.filter((F.col("draws") >= least) & (F.col("k") >= 3) & F.col("sets")).select("game", "source", "draws", "repeats", (F.col("draws") * (F.col("draws") - 1) / 2 / ways).alias("expected"))


def examples_outside(draws: DataFrame, low: int, high: int, most: int = 4) -> DataFrame:
    """Numbers outside the pool with their count and their first draws."""
    out = draws.filter(~F.col("number").between(low, high)).select("game", "number", "draw_number", "draw_date")
    w = Window.partitionBy("game", "number")
    first = out.withColumn("r", F.row_number().over(w.orderBy("draw_date", "draw_number"))).filter(F.col("r") <= most)
    shown = first.groupBy("game", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "draw_number"))), lambda x: x["draw_number"].cast("string")), ",").alias("examples"))
    return out.groupBy("game", "number").agg(F.count(F.lit(1)).alias("n")).join(shown, ["game", "number"])


def pool_calibration(draws: DataFrame, low: int, high: int) -> DataFrame:
    """Games whose supported range is not the declared one."""
    return supported_range(draws).filter((F.col("low") != low) | (F.col("high") != high)).select("game", F.lit(low).alias("declared_low"), F.lit(high).alias("declared_high"), "low", "high")


def concentration(rows: DataFrame, least: int = 5, top: int = 3) -> DataFrame:
    """Winners of each game by outlet (game, outlet): how many, and the most frequent outlets."""
    n = rows.groupBy("game").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    c = rows.filter("outlet <> ''").groupBy("game", "outlet").agg(F.count(F.lit(1)).alias("c"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("game").orderBy(F.col("c").desc(), "outlet")))
    text = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "outlet", "c")))), lambda x: F.concat(x["outlet"], F.lit(" x"), x["c"].cast("string")))
    return n.join(r.groupBy("game").agg(F.max("c").alias("most"), F.count(F.lit(1)).alias("outlets"), F.array_join(text, ", ").alias("top")), "game", "left")


def downsample(draws: DataFrame, points: int) -> DataFrame:
    """About `points` draws of each game at an even stride, and the last one."""
    d = sequence(draws).withColumn("i", F.col("nth") - 1).drop("nth")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / points))
    return d.filter((F.col("i") % step == 0) | (F.col("i") == F.col("n") - 1)).drop("i", "n")


def report_lines(findings: DataFrame) -> DataFrame:
    """Markdown table rows (place, line) of the tested findings, least q first; for write.text once ordered."""
    w = Window.orderBy("q_value", "p_value", "game", "test")  # one row per finding, a few hundred
    cell = lambda c: F.format_string("%.4g", F.col(c).cast("double"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "game", "test", F.col("n").cast("string"), cell("p_value"), cell("q_value")), F.lit(" |"))
    return findings.filter("q_value IS NOT NULL").select(F.row_number().over(w).alias("place"), line.alias("line"))


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
