"""Operators on draw tables: every one is for all games at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import ranks
from .sequence import islands, neighbours, running, sequence, stretches

#: Figures of a draw at or under this many times the floor tell nothing.
AT_FLOOR = 1.02
#: Ranges of p-values that are ranked each in one task.
RANGES = 1024


def coverage(draws: DataFrame, *keys: str) -> DataFrame:
    return draws.groupBy(*(keys or ("game",))).agg(F.countDistinct("draw_number").alias("draws"), F.min("draw_date").alias("first_date"), F.max("draw_date").alias("last_date"), F.count("jackpot_cents").alias("with_jackpot"), F.count("wins").alias("with_wins"))


def latest(draws: DataFrame, n: int = 12) -> DataFrame:
    return draws.orderBy(F.col("draw_date").desc_nulls_last(), F.col("draw_number").desc()).limit(n)


def search(draws: DataFrame, text: str, page: int = 1, per: int = 50) -> DataFrame:
    """One page of the draws in whose number, date or ball the text occurs, newest first."""
    like = f"%{text}%"
    hit = F.col("draw_number").cast("string").ilike(like) | F.col("draw_date").cast("string").ilike(like) | F.col("number").cast("string").ilike(like)
    return draws.filter(hit).orderBy(F.col("draw_date").desc_nulls_last(), F.col("draw_number").desc()).offset(per * (page - 1)).limit(per)


def dense_frequency(draws: DataFrame, low: int, high: int) -> DataFrame:
    """Counts of every number of the pool, zeros too, with expected count and z-score."""
    seen = draws.filter(F.col("number").between(low, high)).groupBy("game", "number").agg(F.count(F.lit(1)).alias("n"))
    grid = seen.select("game").distinct().select("game", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("number"))
    full = grid.join(seen, ["game", "number"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total, k = F.sum("n").over(Window.partitionBy("game")), high - low + 1
    return full.withColumn("expected", total / k).withColumn("z", (F.col("n") - F.col("expected")) / F.sqrt(F.col("expected") * (1 - 1 / k)))


def chi2_uniform(freq: DataFrame) -> DataFrame:
    return freq.groupBy("game").agg(F.sum("n").alias("n"), F.sum(F.pow(F.col("n") - F.col("expected"), 2) / F.col("expected")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"), F.max(F.abs("z")).alias("effect"))


def supported_range(draws: DataFrame, least: int = 3) -> DataFrame:
    seen = draws.groupBy("game", "number").agg(F.count(F.lit(1)).alias("n"))
    own = lambda f: F.coalesce(f(F.when(F.col("n") >= least, F.col("number"))), f("number"))
    return seen.groupBy("game").agg(own(F.min).alias("low"), own(F.max).alias("high"))


def paired(draws: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    x = draws.filter(F.col("source") == a).select("game", "draw_number", F.col("number").alias("number_a"), F.col("jackpot_cents").alias("jackpot_a"), F.col("draw_date").alias("date_a"))
    y = draws.filter(F.col("source") == b).select("game", "draw_number", F.col("number").alias("number_b"), F.col("jackpot_cents").alias("jackpot_b"), F.col("draw_date").alias("date_b"))
    return x.join(y, ["game", "draw_number"])


def agreement(draws: DataFrame) -> DataFrame:
    return paired(draws).groupBy("game").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("number_a") != F.col("number_b")).alias("number_differs"), F.count_if(F.col("date_a") != F.col("date_b")).alias("date_differs"))


def money_scale(draws: DataFrame) -> DataFrame:
    p = paired(draws).filter((F.col("jackpot_a") > 0) & (F.col("jackpot_b") > 0)).withColumn("ratio", F.col("jackpot_b") / F.col("jackpot_a"))
    near = p.groupBy("game").agg(F.avg((F.abs(F.col("ratio") - 1) < 0.02).cast("int")).alias("share_near"))
    middle = ranks.percentile(p, ["game"], "ratio", 0.5, "median_ratio").withColumnRenamed("n", "pairs")
    return middle.join(near, "game").filter("pairs >= 5")


def pair_counts(draws: DataFrame) -> DataFrame:
    """How often two numbers are drawn together; pairs are made inside each draw."""
    one = draws.select("game", F.col("numbers"), F.posexplode("numbers").alias("i", "a"))
    two = one.select("game", "a", F.explode(F.expr("slice(numbers, i + 2, size(numbers))")).alias("b"))
    return two.groupBy("game", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def repeat_sets(draws: DataFrame) -> DataFrame:
    sets = draws.groupBy("game", F.array_join(F.array_sort("numbers"), "-").alias("numbers")).agg(F.count(F.lit(1)).alias("n"))
    return sets.groupBy("game").agg(F.sum("n").alias("draws"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") - 1).alias("repeats"), F.max("n").alias("most"))


def contingency(draws: DataFrame, key: Column, value: str = "number") -> DataFrame:
    """Chi-square and Cramer's V of key against value per game; empty rows and columns do not count, a 2 x 2 table is corrected for continuity."""
    cells = draws.groupBy("game", key.alias("r"), F.col(value).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("game", "r").agg(F.sum("n").alias("nr"))
    cols = cells.groupBy("game", "c").agg(F.sum("n").alias("nc"))
    total = rows.groupBy("game").agg(F.sum("nr").alias("t"), F.count(F.lit(1)).alias("kr")).join(cols.groupBy("game").agg(F.count(F.lit(1)).alias("kc")), "game")
    grid = rows.join(cols, "game").join(total, "game").join(cells, ["game", "r", "c"], "left")
    e = F.col("nr") * F.col("nc") / F.col("t")
    off = F.abs(F.coalesce("n", F.lit(0)) - e)
    off = F.when((F.col("kr") == 2) & (F.col("kc") == 2), off - F.least(off, F.lit(0.5))).otherwise(off)
    got = grid.groupBy("game").agg(F.sum(off * off / e).alias("chi2"), F.max("t").alias("n"), F.max((F.col("kr") - 1) * (F.col("kc") - 1)).alias("dof"), F.max(F.least("kr", "kc") - 1).alias("m"))
    return got.withColumn("cramers_v", F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * F.col("m")))).drop("m")


def lag_overlap(draws: DataFrame, lags: tuple[int, ...] = (1, 2, 3), keys: Sequence[str] = ("game",)) -> DataFrame:
    """Numbers that each draw shares with the one `lag` draws before, in all; draws without such a one count as drawn."""
    out = neighbours(sequence(draws), {f"p{k}": ("numbers", k) for k in lags})
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.size(F.array_intersect("numbers", f"p{k}")).alias("o")) for k in lags]))
    long = out.select(*keys, pairs.alias("s")).select(*keys, "s.*")
    return long.groupBy(*keys, "lag").agg(F.sum(F.when(F.col("o") >= 0, F.col("o"))).alias("overlap"), F.count(F.lit(1)).alias("draws"))


def consecutive(draws: DataFrame) -> DataFrame:
    near = F.exists(F.sequence(F.lit(1), F.size("numbers") - 1), lambda i: F.get("numbers", i) - F.get("numbers", i - 1) == 1)
    return draws.groupBy("game").agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("hits"))


def jackpot_floor(draws: DataFrame, least: int = 20) -> DataFrame:
    """The most frequent figure of the lowest two fifths (of several the first drawn) if it makes 15% of them, else the least."""
    v = draws.filter(F.col("jackpot_cents") > 0).select("game", "jackpot_cents", F.struct("draw_date", "draw_number").alias("at"))
    cut = ranks.percentile(v, ["game"], "jackpot_cents", 0.4, "p40").filter(F.col("n") >= least)
    tail = v.join(cut, "game").filter("jackpot_cents <= p40").groupBy("game", "jackpot_cents").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("at"))
    order = F.struct(-F.col("c"), "at")
    top = tail.groupBy("game").agg(F.sum("c").alias("t"), F.min("jackpot_cents").alias("least"), F.max("c").alias("c"), F.min_by("jackpot_cents", order).alias("top"))
    return top.select("game", F.when(F.col("c") >= 0.15 * F.col("t"), F.col("top")).otherwise(F.col("least")).alias("floor_cents"))


def with_floor(draws: DataFrame) -> DataFrame:
    """Draws that show a jackpot, with their game's floor (null where too few show one) and whether they are at it."""
    d = draws.filter(F.col("jackpot_cents") > 0).join(F.broadcast(written(jackpot_floor(draws), "floors")), "game", "left")
    return d.withColumn("at_floor", F.coalesce(F.col("jackpot_cents") <= F.col("floor_cents") * AT_FLOOR, F.lit(False)))


def undetermined_draws(draws: DataFrame) -> DataFrame:
    """game, draw_number of the draws at the floor, the last one too: neither a win nor a roll shows there."""
    return with_floor(draws).filter("at_floor").select("game", "draw_number")


def inferred_wins(draws: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Draws whose top prize seems to have fallen, as the next figure is lower, and those at the floor, of which none can tell.

    shown: `with_floor` of the draws, where the caller has it already.
    """
    seq = sequence(with_floor(draws) if shown is None else shown)
    d = neighbours(seq, {"prev_jackpot": ("jackpot_cents", 1), "next_jackpot": ("jackpot_cents", -1)}).filter("next_jackpot IS NOT NULL")
    ratio, floor = F.col("next_jackpot") / F.col("jackpot_cents"), F.col("at_floor")
    d = d.withColumn("method", F.when(floor, "at_jackpot_floor").when(ratio < 0.9, "jackpot_drop").when(ratio < 1, "jackpot_drop_small"))
    d = d.withColumn("verdict", F.when(floor, "undetermined").otherwise("win"))
    d = d.withColumn("confidence", F.when(floor, 0.0).when(ratio < 0.7, 0.95).when(ratio < 0.9, 0.7).otherwise(0.35)).filter("method IS NOT NULL")
    agrees = F.when(F.col("wins").isNotNull() & ~floor, ((F.col("wins") > 0) == (F.col("confidence") >= 0.6)).cast("int"))
    columns = ["game", "draw_number", "draw_date", "prev_jackpot", F.col("jackpot_cents").alias("this_jackpot"), "next_jackpot"]
    return d.select(*columns, "method", "verdict", "confidence", F.col("wins").alias("published_wins"), agrees.alias("agrees_with_published"))


def confusion(draws: DataFrame, least: float = 0.6) -> DataFrame:
    """The rule against the published wins: draws with a jackpot and a count of wins, less those at the floor."""
    have = draws.filter("jackpot_cents > 0 AND wins IS NOT NULL").select("game", "draw_number", "wins")
    shown = have.groupBy("game").agg(F.count(F.lit(1)).alias("have"), F.avg((F.col("wins") > 0).cast("int")).alias("won_rate"))
    floors = with_floor(draws)
    said = inferred_wins(draws, floors).filter((F.col("verdict") == "win") & (F.col("confidence") >= least)).select("game", "draw_number", F.lit(True).alias("said"))
    j = have.join(floors.filter("at_floor").select("game", "draw_number"), ["game", "draw_number"], "left_anti").join(said, ["game", "draw_number"], "left")
    said, won, lost = F.coalesce("said", F.lit(False)), F.col("wins") > 0, F.col("wins") == 0
    sums = [F.count_if(c).alias(n) for n, c in (("tp", said & won), ("fp", said & lost), ("fn", ~said & won), ("tn", ~said & lost))]
    return j.groupBy("game").agg(F.count(F.lit(1)).alias("scored"), *sums).join(shown, "game")


def rollover_runs(draws: DataFrame) -> DataFrame:
    """Lengths of the runs that a win closes, over draws with a count of wins; an unfinished run does not count."""
    won = (F.col("wins") > 0).cast("int")
    runs = running(sequence(draws.filter("wins IS NOT NULL")), won, "upto").withColumn("run", F.col("upto") - won)
    runs = runs.groupBy("game", "run").agg(F.count(F.lit(1)).alias("length"), F.max(won).alias("won")).filter("won > 0")
    return runs.groupBy("game", "length").agg(F.count(F.lit(1)).alias("runs"))


def cusum(draws: DataFrame, value: str = "number", least: int = 50) -> DataFrame:
    """Where the centred running sum is farthest from zero (the first such draw, from 1 on), and how far over root n; games of `least` draws.

    Sums of whole numbers stay whole (times the draws), so ties are exact.
    """
    seq = sequence(draws).filter(F.col("n") >= least)
    total = seq.groupBy("game").agg(F.sum(value).alias("total"))
    c = running(seq, F.col(value), "sum").join(F.broadcast(total), "game")
    far = F.abs(F.col("sum") * F.col("n") - F.col("total") * F.col("nth"))
    got = c.groupBy("game").agg(F.max("n").alias("n"), F.max(F.struct(far.alias("far"), (-F.col("nth")).alias("neg"))).alias("m"))
    return got.select("game", "n", (-F.col("m.neg")).alias("at"), (F.col("m.far") / F.col("n") / F.sqrt("n")).alias("magnitude"))


def era_segments(draws: DataFrame, half: int) -> DataFrame:
    """Runs of equal centred rolling maximum of the numbers."""
    near = Window.partitionBy("game", "stretch").orderBy("nth").rowsBetween(-half, half)
    x = stretches(sequence(draws), half, half).withColumn("top", F.max("number").over(near)).filter("home").drop("home", "stretch")
    return islands(x, "top").withColumns({c: F.col(c).cast("int") for c in ("first", "last")})


def autocorrelation(draws: DataFrame, lags: tuple[int, ...] = (1,)) -> DataFrame:
    """Correlation of each number with the one `lag` draws before; 0 if either end does not vary; games of more than lag + 30 draws."""
    d = neighbours(sequence(draws), {f"y{k}": ("number", k) for k in lags})
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"y{k}").alias("y")) for k in lags]))
    both = d.select("game", "n", "number", ends.alias("s")).select("game", "n", "number", "s.*").filter("y IS NOT NULL AND n > lag + 30")
    flat = (F.stddev_pop("number") == 0) | (F.stddev_pop("y") == 0)
    return both.groupBy("game", "lag").agg(F.count(F.lit(1)).alias("pairs"), F.when(flat, 0.0).otherwise(F.corr("number", "y")).alias("r"))


def benjamini_hochberg(results: DataFrame, p: str = "p_value") -> DataFrame:
    """Adds q_value; rows without p keep none.

    The rank of a p is the number of results up to it, and its q the least p * m / rank from it on. Both come from
    the different p and their counts, in ranges: each range is counted and its least q taken, and what lies in
    the ranges before or behind is added, so that a table of any size is dealt to many tasks.
    """
    tested = F.col(p).isNotNull() & ~F.isnan(p)
    kinds = results.filter(tested).groupBy(F.col(p).cast("double").alias("p_")).agg(F.count(F.lit(1)).alias("c_"))
    kinds = kinds.withColumn("part_", F.floor(F.least(F.greatest("p_", F.lit(0.0)), F.lit(1.0)) * RANGES))
    parts = kinds.groupBy("part_").agg(F.sum("c_").alias("s_"))
    order = Window.orderBy("part_")  # at most RANGES + 1 rows
    parts = parts.select("part_", F.coalesce(F.sum("s_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below_"), F.sum("s_").over(Window.partitionBy()).alias("m_"))
    own = Window.partitionBy("part_").orderBy("p_")
    ranked = kinds.join(F.broadcast(parts), "part_").withColumn("rank_", F.col("below_") + F.sum("c_").over(own)).withColumn("raw_", F.col("p_") * F.col("m_") / F.col("rank_"))
    least = ranked.groupBy("part_").agg(F.min("raw_").alias("l_"))
    behind = least.select(F.col("part_").alias("b_part"), F.min("l_").over(Window.orderBy(F.col("part_").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("behind_"))
    inner = F.min("raw_").over(Window.partitionBy("part_").orderBy(F.col("p_").desc()))
    q = ranked.withColumn("inner_", inner).join(F.broadcast(behind), F.col("part_") == F.col("b_part")).select(F.col("p_").alias("q_p"), F.least("inner_", "behind_", F.lit(1.0)).alias("q_"))
    return results.join(q, F.col(p).cast("double") == F.col("q_p"), "left").withColumn("q_value", F.when(tested, F.col("q_"))).select(*results.columns, "q_value")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest non-null value of every column per key; rows without a key are all kept."""
    both = old.unionByName(new)
    rest = [c for c in old.columns if c not in (*keys, order)]
    has = F.lit(True)
    for k in keys:
        has = has & F.col(k).isNotNull()
    merged = both.filter(has).groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest], F.max(order).alias(order))
    return merged.select(old.columns).unionByName(both.filter(~has).select(old.columns))


def best_match(cards: DataFrame, draws: DataFrame) -> DataFrame:
    """Links each card (card_id, game, number, card_date) to a draw of its numbers, one of its date first.

    Cards meet the first draw of their numbers, and of their numbers and date; no pairs of a group are made.
    """
    d = draws.select("game", "number", "draw_number", "draw_date")
    every = d.groupBy("game", "number").agg(F.min(F.struct("draw_date", "draw_number")).alias("any"))
    dated = d.filter("draw_date IS NOT NULL").groupBy("game", "number", F.col("draw_date").alias("card_date")).agg(F.min(F.struct("draw_date", "draw_number")).alias("same"))
    c = cards.join(every, ["game", "number"]).join(dated, ["game", "number", "card_date"], "left")
    first = F.min(F.struct(F.col("same").isNull().alias("other"), F.coalesce("same", "any").alias("draw"))).alias("f")
    return c.groupBy("card_id").agg(first).select("card_id", F.col("f.draw.draw_number").alias("draw_number"), F.when(F.col("f.other"), "numbers").otherwise("numbers+date").alias("method"))
