"""The tests of a draw archive as rows of results, each for all games and eras at once.

Every test yields game, test, scope, statistic, dof, n, effect, detail and the law,
x, a and b from which one pass over the few results takes its p-value. To add a
test, write a function of Slices and `register` it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, reduce
from inspect import signature

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..sources.tables import written
from . import battery as bt
from . import core as op
from . import draws as dr
from . import nulls, ranks
from .fits import geometric_fit
from .sequence import neighbours, sequence

#: Games with fewer draws are not tested.
LEAST_DRAWS = 50
COLUMNS = "game string, test string, scope string, statistic double, dof double, n long, effect double, detail string, law string, x double, a double, b double"


def choose(n: Column, k: Column) -> Column:
    """Ways to draw k of n, as a double."""
    return F.aggregate(F.sequence(F.lit(1), k), F.lit(1.0), lambda acc, i: acc * (n - k + i) / i)


def rows(df: DataFrame, test, scope, n, statistic=None, dof=None, effect=None, detail="", law=None, x=None, a=None, b=None) -> DataFrame:
    """Result rows of df; scope takes the era's tag where df has one."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    number = lambda v: lit(v).cast("double")
    if "tag" in df.columns:
        scope = F.when(F.col("tag") != "", F.concat(lit(scope), F.lit(" ["), "tag", F.lit("]"))).otherwise(lit(scope))
    return df.select(
        F.col("title" if "title" in df.columns else "game").alias("game"), lit(test).alias("test"), lit(scope).alias("scope"), number(statistic).alias("statistic"), number(dof).alias("dof"),
        lit(n).cast("long").alias("n"), number(effect).alias("effect"), lit(detail).alias("detail"), lit(law).cast("string").alias("law"), number(x).alias("x"), number(a).alias("a"), number(b).alias("b"),
    )


@dataclass
class Slices:
    """What the tests read: all sources' rows, merged draws, meta and eras of each game, and the draws of each era, each written once."""

    raw: DataFrame
    games: DataFrame
    priority: Sequence[str]
    zero_games: Sequence[str] = ()
    sims: int = 3000

    @cached_property
    def rows(self) -> DataFrame:
        """raw, with the number of rows that share a game and draw number."""
        return written(dr.with_rows(self.raw), "raw")

    @cached_property
    def draws(self) -> DataFrame:
        merged = written(dr.load_draws(self.rows, self.priority, self.zero_games), "draws")
        many = merged.groupBy("game").agg(F.count(F.lit(1)).alias("c_")).filter(F.col("c_") >= LEAST_DRAWS).select("game")
        return merged.join(F.broadcast(written(many, "games")), "game", "left_semi")

    @cached_property
    def eras(self) -> DataFrame:
        return written(dr.pool_eras(self.draws), "eras")

    @cached_property
    def meta(self) -> DataFrame:
        return written(dr.game_meta(self.draws, self.games, self.eras), "meta")

    @cached_property
    def sliced(self) -> DataFrame:
        return written(dr.era_slices(self.draws, self.meta, self.eras), "slices")

    def prepare(self) -> None:
        """Writes what all tests read, before several of them run at a time."""
        _ = self.draws, self.eras, self.meta, self.sliced

    def only(self, game: str) -> Slices:
        """The same of one game."""
        one = Slices(self.raw.filter(F.col("game") == game), self.games.filter(F.col("code") == game), self.priority, self.zero_games, self.sims)
        own = {"rows": "game", "draws": "game", "eras": "game", "meta": "game", "sliced": "title"}
        one.__dict__.update({k: getattr(self, k).filter(F.col(c) == game) for k, c in own.items()})
        return one

    @cached_property
    def whole(self) -> DataFrame:
        """Draws with meta and no eras."""
        return self.draws.join(F.broadcast(self.meta), "game")

    @cached_property
    def inside(self) -> DataFrame:
        """Sliced draws cut to their pool, sorted, without repeats; only those of full size."""
        own = F.array_sort(F.array_distinct(F.filter("numbers", lambda v: (v >= F.col("pool_min")) & (v <= F.col("pool_max")))))
        return self.sliced.withColumn("numbers", own).filter(F.size("numbers") == F.col("picks"))


UNIT = ["title", "tag", "game", "pool_min", "pool_max", "picks"]


def pool_size() -> Column:
    return F.col("pool_max") - F.col("pool_min") + 1


def number_frequency(s: Slices) -> DataFrame:
    """Counts of each number against equal ones; Monte-Carlo null where a draw has several numbers. Eras, where there are any, in one row more."""
    own = F.filter("numbers", lambda v: (v >= F.col("pool_min")) & (v <= F.col("pool_max")))
    d = s.sliced.withColumn("numbers", own).filter(F.size("numbers") == F.col("picks"))
    per = d.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n")).filter("n >= 100")
    seen = d.select("game", F.explode("numbers").alias("number")).groupBy("game", "number").agg(F.count(F.lit(1)).alias("c"))
    grid = per.select("*", F.explode(F.sequence("pool_min", "pool_max")).alias("number")).join(seen, ["game", "number"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    e = F.col("n") * F.col("picks") / pool_size()
    hot, cold = F.max(F.struct("c", (-F.col("number")).alias("m"))), F.min(F.struct("c", "number"))
    g = grid.groupBy(*UNIT, "n").agg(F.sum(F.pow(F.col("c") - e, 2) / e).alias("chi2"), F.max(F.abs(F.col("c") - e) / F.sqrt(e)).alias("far"), hot.alias("hot"), cold.alias("cold")).withColumn("e", e)
    z = lambda c: (c - F.col("e")) / F.sqrt("e")
    one = F.col("picks") == 1
    detail = F.format_string(
        "%d draws of %d-%d, null %s; most %d (%d, z %+.2f), least %d (%d, z %+.2f)", "n", "pool_min", "pool_max", F.when(one, "chi-square").otherwise(f"of {s.sims} simulations"),
        -F.col("hot.m"), F.col("hot.c"), z(F.col("hot.c")), F.col("cold.number"), F.col("cold.c"), z(F.col("cold.c")),
    )
    g = nulls.with_frequency_p(g.withColumn("k", F.col("picks")).withColumn("pool", pool_size()), s.sims)
    g = g.withColumn("scope", F.when(F.col("tag") == "", "all draws").otherwise(F.col("tag"))).drop("tag")
    law, x = F.when(one, "chi2").otherwise("given"), F.when(one, F.col("chi2")).otherwise(F.col("mc_p"))
    out = rows(g, "number_frequency", F.col("scope"), F.col("n"), F.col("chi2"), F.when(one, pool_size() - 1), F.col("far"), detail, law, x, pool_size() - 1)
    spans = s.eras.groupBy("game", "era", "label", "pool_min", "pool_max").agg(F.sum(F.col("last") - F.col("first") + 1).alias("c"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("era", "label", "pool_min", "pool_max", "c"))), lambda v: F.format_string("%s %d-%d (%d draws)", v["label"], v["pool_min"], v["pool_max"], v["c"]))
    said = spans.groupBy("game").agg(F.array_join(said, "; ").alias("said")).join(F.broadcast(s.meta.select("game", "draws")), "game")
    return out.unionByName(rows(said, "pool_eras", "ball pool changes", F.col("draws"), detail=F.concat(F.lit("tested within each: "), "said")))


def positional_frequency(s: Slices) -> DataFrame:
    """Each place of ordered games by itself."""
    d = s.whole.filter(F.col("ordered") & (F.size("numbers") == F.col("picks")))
    c = d.select("game", "pool_min", "pool_max", "picks", F.posexplode("numbers").alias("pos", "number")).filter(F.col("number").between(F.col("pool_min"), F.col("pool_max")))
    c = c.groupBy("game", "pool_min", "pool_max", "picks", "pos", "number").agg(F.count(F.lit(1)).alias("n"))
    g = bt.chi2_counts(c, ["game", "pos", "picks"], F.max(pool_size())).filter("n >= 100")
    detail = F.format_string("place %d of %d: %d values over %d outcomes", F.col("pos") + 1, "picks", "n", F.col("dof") + 1)
    return rows(g, "positional_frequency", F.format_string("position %d", F.col("pos") + 1), F.col("n"), F.col("chi2"), F.col("dof"), F.col("effect"), detail, "chi2", F.col("chi2"), F.col("dof"))


def bonus_frequency(s: Slices) -> DataFrame:
    """The bonus number over its pool, widened to what is seen; one of two values only is a flag."""
    if "bonus_number" not in s.draws.columns:
        return s.draws.sparkSession.createDataFrame([], COLUMNS)
    d = s.whole.filter(F.col("bonus_name").isNotNull() & F.col("bonus_number").isNotNull())
    per = d.groupBy("game", "bonus_name").agg(F.count(F.lit(1)).alias("all"), F.sort_array(F.collect_set("bonus_number")).alias("values"), F.max("bonus_number").alias("top"), F.max("bonus_min").alias("lo"), F.max("bonus_max").alias("hi")).filter("all >= 100")
    flags = per.filter(F.size("values") < 3)
    flags = rows(flags, "bonus_field_is_a_flag", F.col("bonus_name"), F.col("all"), detail=F.concat(F.lit("takes only "), F.array_join(F.transform("values", lambda v: v.cast("string")), ", ")))
    per = per.filter(F.size("values") >= 3).select("game", "bonus_name", F.coalesce("lo", F.array_min("values")).alias("lo"), F.greatest("hi", "top").alias("hi"))
    c = d.select("game", "bonus_number").join(F.broadcast(per), "game").filter(F.col("bonus_number").between(F.col("lo"), F.col("hi")))
    c = c.groupBy("game", "bonus_name", "lo", "hi", "bonus_number").agg(F.count(F.lit(1)).alias("n"))
    g = bt.chi2_counts(c, ["game", "bonus_name", "lo", "hi"], F.max(F.col("hi") - F.col("lo") + 1))
    detail = F.format_string("%s of %d-%d over %d draws", "bonus_name", "lo", "hi", "n")
    return flags.unionByName(rows(g, "bonus_frequency", F.col("bonus_name"), F.col("n"), F.col("chi2"), F.col("dof"), F.col("effect"), detail, "chi2", F.col("chi2"), F.col("dof")))


def lag_repeat(s: Slices, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Numbers carried over to a later draw, against the same draws in random order (its mean and variance in closed form)."""
    d = s.sliced.filter(F.size("numbers") == F.col("picks")).withColumn("numbers", F.array_distinct("numbers"))
    null = nulls.order_null(d.select("game", "numbers")).filter("n >= 200")
    seen = op.lag_overlap(d.select(*UNIT, "draw_date", "draw_number", "numbers"), tuple(lags), UNIT)
    g = seen.join(null, "game").withColumn("pairs", F.col("n") - F.col("lag")).withColumn("centre", F.col("pairs") * F.col("pair_mean"))
    detail = F.format_string("mean carry-over %.4f against %.4f in random order (pool %d, k=%d)", F.col("overlap") / F.col("pairs"), "pair_mean", pool_size(), "picks")
    return rows(g, "lag_repeat", F.format_string("lag %d", "lag"), F.col("pairs"), F.col("overlap"), None, (F.col("overlap") - F.col("centre")) / F.col("pairs"), detail, "normal", F.col("overlap") - F.col("centre"), 0.0, F.sqrt(F.col("pairs") * F.col("pair_variance")))


def autocorrelation(s: Slices, lags: Sequence[int] = (1, 2, 3, 4, 5, 7, 10), least: int = 500) -> DataFrame:
    """Serial correlation of games of one number, against random order (mean -1/(n-1), variance 1/(n-1))."""
    d = s.whole.filter((F.col("picks") == 1) & (F.size("numbers") == 1)).select("game", "draw_date", "draw_number", F.get("numbers", F.lit(0)).alias("number"))
    many = d.groupBy("game").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    g = op.autocorrelation(d.join(F.broadcast(many.select("game")), "game", "left_semi"), tuple(lags)).join(many, "game")
    detail = F.format_string("Pearson r %+.4f at lag %d", "r", "lag")
    return rows(g, "autocorrelation", F.format_string("lag %d", "lag"), F.col("n"), F.col("r"), None, F.col("r"), detail, "normal", F.col("r"), -1 / (F.col("n") - 1), 1 / F.sqrt(F.col("n") - 1))


def pair_cooccurrence(s: Slices, top: int = 5) -> DataFrame:
    """How often each two numbers come together, those that never do too."""
    d = s.inside.filter((F.col("picks") >= 2) & ~F.col("ordered"))
    per = d.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n")).filter("n >= 300")
    c = op.pair_counts(d.select("game", "numbers")).withColumnRenamed("n", "c")
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "a", "b", "c")))), 1, top)
    ranked = c.withColumn("r", F.row_number().over(Window.partitionBy("game").orderBy(F.col("c").desc(), "a", "b")))  # as many rows as a pool has pairs
    g = ranked.groupBy("game").agg(F.sum(F.col("c") * F.col("c")).alias("squares"), F.max("c").alias("most"), first.alias("first")).join(per, "game")
    k = F.col("picks")
    g = g.withColumn("pairs", pool_size() * (pool_size() - 1) / 2).withColumn("e", F.col("n") * (k * (k - 1) / 2) / F.col("pairs"))
    chi2 = F.col("squares") / F.col("e") - F.col("n") * (k * (k - 1) / 2)
    said = F.array_join(F.transform("first", lambda v: F.format_string("%d+%d:%d", v["a"], v["b"], v["c"])), ", ")
    detail = F.format_string("%d pairs, %.1f of each expected; most %s", F.col("pairs").cast("int"), "e", said)
    return rows(g, "pair_cooccurrence", "all pairs", F.col("n"), chi2, F.col("pairs") - 1, (F.col("most") - F.col("e")) / F.sqrt("e"), detail, "chi2", chi2, F.col("pairs") - 1)


def consecutive_numbers(s: Slices) -> DataFrame:
    """Draws that hold two neighbouring numbers."""
    near = F.exists(F.sequence(F.lit(1), F.size("numbers") - 1), lambda i: F.get("numbers", i) - F.get("numbers", i - 1) == 1)
    d = s.inside.filter((F.col("picks") >= 2) & ~F.col("ordered"))
    g = d.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("hits")).filter("n >= 300")
    k = F.col("picks")
    g = g.withColumn("p", 1 - F.when(pool_size() - k + 1 >= k, choose(pool_size() - k + 1, k)).otherwise(0.0) / choose(pool_size(), k))
    detail = F.format_string("%d of %d draws (%.3f%%) hold neighbours, %.3f%% expected", "hits", "n", F.col("hits") / F.col("n") * 100, F.col("p") * 100)
    return rows(g, "consecutive_numbers", "any adjacent pair", F.col("n"), F.col("hits"), None, F.col("hits") / F.col("n") - F.col("p"), detail, "binom", F.col("hits"), F.col("n"), F.col("p"))


def repeat_sets(s: Slices) -> DataFrame:
    """Whole sets drawn again; only of games whose draws are sets."""
    d = s.sliced.filter((F.col("picks") >= 3) & ~F.col("ordered") & (F.size("numbers") == F.col("picks")))
    sets = d.groupBy(*UNIT, F.array_sort("numbers").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "s", "c"))))
    # Only sets drawn several times are ranked, by their count alone first, so that few meet.
    twice = sets.filter("c > 1").withColumn("r", F.row_number().over(Window.partitionBy("game").orderBy(F.col("c").desc(), "s"))).filter("r <= 3")
    said = F.array_join(F.transform(first, lambda v: F.format_string("%s x%d", F.array_join(F.transform(v["s"], lambda x: x.cast("string")), "-"), v["c"])), ", ")
    said = twice.groupBy("game").agg(said.alias("said"))
    distinct = F.bool_and(F.size(F.array_distinct("s")) == F.size("s"))
    g = sets.groupBy(*UNIT).agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("repeats"), distinct.alias("sets")).filter("sets AND n >= 300").join(said, "game", "left")
    g = g.withColumn("ways", choose(pool_size(), F.col("picks"))).withColumn("e", F.col("n") * (F.col("n") - 1) / 2 / F.col("ways"))
    detail = F.concat_ws("; ", F.format_string("%d repeated sets over %d draws, %.2f expected of %.0f possible sets", "repeats", "n", "e", "ways"), "said")
    return rows(g, "repeat_sets", "identical number sets", F.col("n"), F.col("repeats"), None, F.col("repeats") - F.col("e"), detail, "poisson", F.col("repeats"), F.col("e"))


def digit_tests(s: Slices, game: str = "pick4") -> DataFrame:
    """Four ordered digits: their sum, quads, and four different ones."""
    g = bt.digit_tests(s.draws.filter(F.col("game") == game)).filter("n >= 300")
    n, out = F.col("n"), []
    out.append(rows(g, "pick4_digit_sum", "sum of the four digits", n, F.col("chi2"), F.col("dof"), None, F.format_string("digit sums of %d draws against uniform digits", "n"), "chi2", F.col("chi2"), F.col("dof")))
    for test, scope, c, p in (("pick4_all_same", "quads", "all_same", 10 / 10_000), ("pick4_all_distinct", "four different digits", "all_distinct", 5040 / 10_000)):
        out.append(rows(g, test, scope, n, F.col(c), None, F.col(c) / n - p, F.format_string("%d of %d draws, %.1f expected", c, "n", n * p), "binom", F.col(c), n, p))
    return out[0].unionByName(out[1]).unionByName(out[2])


def _by_group(s: Slices, test: str, scope: str, key: Column) -> DataFrame:
    d = s.sliced.select(*UNIT, key.alias("key"), F.explode("numbers").alias("number")).filter(F.col("key").isNotNull() & F.col("number").between(F.col("pool_min"), F.col("pool_max")))
    per = d.groupBy(*UNIT).agg(F.sort_array(F.collect_set("key")).alias("keys"), F.count(F.lit(1)).alias("balls")).filter((F.size("keys") >= 2) & (F.col("balls") >= 500))
    g = op.contingency(d.select("game", "key", "number"), F.col("key")).join(per, "game").filter("dof > 0")
    detail = F.format_string("%d groups (%s) x %d numbers, Cramer V %.4f", F.size("keys"), F.array_join(F.slice("keys", 1, 8), ", "), pool_size(), "cramers_v")
    return rows(g, test, scope, F.col("balls"), F.col("chi2"), F.col("dof"), F.col("cramers_v"), detail, "chi2", F.col("chi2"), F.col("dof"))


def by_period(s: Slices) -> DataFrame:
    return _by_group(s, "number_by_period", "draw period x number", F.col("draw_period") if "draw_period" in s.draws.columns else F.lit(None).cast("string"))


def by_dow(s: Slices) -> DataFrame:
    return _by_group(s, "number_by_dow", "day of week x number", F.weekday("draw_date").cast("string"))


def by_era(s: Slices, years: int = 3) -> DataFrame:
    y = F.year("draw_date")
    return _by_group(s, "number_by_era", f"{years}-year era x number", F.concat((y - y % years).cast("string"), F.lit("s")))


def rate_changepoint(s: Slices, top: int = 3) -> DataFrame:
    """The numbers whose rate changes most and where; fair series peak somewhere too, so there is no p-value."""
    seq = written(sequence(s.sliced.select(*UNIT, "draw_date", "draw_number", F.array_distinct("numbers").alias("numbers"))).filter("n >= 500"), "sequence")
    long = seq.select(*UNIT, "draw_date", "nth", "n", F.explode("numbers").alias("number")).filter(F.col("number").between(F.col("pool_min"), F.col("pool_max")))
    b = bt.peaks(long, top).join(s.sliced.select("title", "tag", "game").distinct(), "game")
    at = seq.select("game", F.col("nth").alias("at"), "draw_date")
    b = b.join(at, ["game", "at"])
    detail = F.format_string("rate %.4f up to %s (draw %d), then %.4f", F.coalesce("before", F.lit(float("nan"))), F.col("draw_date").cast("string"), "at", F.coalesce("after", F.lit(float("nan"))))
    return rows(b, "rate_changepoint", F.format_string("number %d", "number"), F.col("n"), F.col("magnitude"), None, F.col("after") - F.col("before"), detail)


def jackpot_drop_inference(s: Slices) -> DataFrame:
    """Precision and recall of the drop rule, for rolling jackpots with enough published wins."""
    d = s.whole.filter("has_jackpot")
    g = op.confusion(d).filter("have >= 50 AND won_rate <= 0.5 AND scored >= 30")
    share = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    detail = F.format_string("%d draws have a jackpot and a win count, %d of them at the floor; of the other %d TP=%d FP=%d FN=%d TN=%d", "have", F.col("have") - F.col("scored"), "scored", "tp", "fp", "fn", "tn")
    detail = F.concat_ws("; ", detail, F.format_string("precision %.3f", share("tp", "fp")), F.format_string("recall %.3f", share("tp", "fn")))
    return rows(g, "jackpot_drop_inference", "rule vs published wins", F.col("scored"), F.col("tp"), None, share("tp", "fp"), detail)


def rollover_geometry(s: Slices) -> DataFrame:
    """Whether runs between wins are geometric; a prize that mostly falls is no rolling jackpot and is described only."""
    d = s.whole.filter("has_jackpot AND wins IS NOT NULL")
    per = d.groupBy("game").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("wins") > 0).alias("won")).filter("n >= 100").withColumn("rate", F.col("won") / F.col("n"))
    often = rows(per.filter("rate > 0.5"), "top_prize_frequency", "not a rolling jackpot", F.col("n"), None, None, F.col("rate"), F.format_string("won on %d of %d draws (%.1f%%)", "won", "n", F.col("rate") * 100))
    rare = per.filter("rate <= 0.5")
    g = geometric_fit(op.rollover_runs(d.join(F.broadcast(rare.select("game")), "game", "left_semi"))).join(rare, "game").filter("runs >= 10")
    detail = F.format_string("%d wins over %d draws; win rate %.4f (mean run %.1f)", "runs", "n", "p_hat", 1 / F.col("p_hat"))
    return often.unionByName(rows(g, "rollover_geometry", "rollover run lengths", F.col("runs"), F.col("chi2"), None, F.col("p_hat"), detail, "chi2", F.col("chi2"), F.col("dof")))


def won_draw_low_numbers(s: Slices, low: int = 31) -> DataFrame:
    """Share of numbers up to 31 in won and rolled draws: what players choose, not how balls fall."""
    d = s.whole.filter((F.col("has_jackpot")) & (F.col("pool_max") >= low) & (F.col("wins") >= 0))
    won = F.col("wins") > 0
    per = d.groupBy("game").agg(F.count_if(won).alias("won"), F.count_if(~won).alias("lost")).filter("won >= 25 AND lost >= 100")
    balls = d.select("game", won.alias("w"), F.explode("numbers").alias("number")).withColumn("l", F.col("number") <= low)
    share = balls.groupBy("game").agg(F.avg(F.when(F.col("w"), F.col("l").cast("int"))).alias("a"), F.avg(F.when(~F.col("w"), F.col("l").cast("int"))).alias("b"))
    g = op.contingency(balls, F.col("w"), "l").join(per, "game").join(share, "game").filter("dof > 0")
    detail = F.format_string("%.3f%% of the balls of %d won draws are up to %d, %.3f%% of %d rolled ones", F.col("a") * 100, "won", F.lit(low), F.col("b") * 100, "lost")
    return rows(g, "won_draw_low_number_share", f"numbers <= {low}", F.col("n"), F.col("chi2"), F.col("dof"), F.col("a") - F.col("b"), detail, "chi2", F.col("chi2"), F.col("dof"))


def out_of_pool_values(s: Slices, most: int = 4) -> DataFrame:
    """Numbers outside the range of those used three times or more: slips of the pen."""
    long = s.draws.select("game", F.explode("numbers").alias("number"))
    c = long.groupBy("game", "number").agg(F.count(F.lit(1)).alias("c"))
    own = c.filter("c >= 3").groupBy("game").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    bad = c.join(own, "game").filter(~F.col("number").between(F.col("lo"), F.col("hi")))
    said = F.transform(F.array_sort(F.collect_list(F.struct("number", "c"))), lambda v: F.format_string("%d x%d", v["number"], v["c"]))
    g = bad.groupBy("game", "lo", "hi").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds"), F.array_join(said, ", ").alias("said"))
    odd = s.draws.join(F.broadcast(own), "game").filter(F.exists("numbers", lambda v: (v < F.col("lo")) | (v > F.col("hi"))))
    odd = odd.withColumn("r", F.row_number().over(Window.partitionBy("game").orderBy("draw_date", "draw_number"))).filter(F.col("r") <= most)
    seen = F.transform(F.array_sort(F.collect_list(F.struct("r", "draw_number", "draw_date"))), lambda v: F.format_string("draw %d (%s)", v["draw_number"], v["draw_date"].cast("string")))
    g = g.join(odd.groupBy("game").agg(F.array_join(seen, "; ").alias("seen")), "game")
    return rows(g, "out_of_pool_values", F.format_string("outside %d-%d", "lo", "hi"), F.col("n"), None, None, F.col("kinds"), F.concat("said", F.lit("; "), "seen"))


def source_agreement(s: Slices, least: int = 20, most: int = 5) -> DataFrame:
    """Draws that several sources carry: numbers in any order, and dates. A game's few examples go with it."""
    d = s.rows.filter("draw_number IS NOT NULL AND rows_ > 1").withColumn("set_", F.array_sort(F.array_distinct("numbers")))
    said = F.transform(F.array_sort(F.collect_set(F.struct("source", "numbers"))), lambda v: F.concat(v["source"], F.lit("="), v["numbers"].cast("string")))
    kinds = lambda c: F.size(F.collect_set(c))  # noqa: E731  of one draw's few sources
    g = d.groupBy("game", "draw_number").agg(kinds("source").alias("sources"), kinds("set_").alias("sets"), kinds("draw_date").alias("dates"), F.array_join(said, " vs ").alias("said")).filter("sources > 1")
    bad = g.filter("sets > 1").withColumn("r", F.row_number().over(Window.partitionBy("game").orderBy("draw_number"))).filter(F.col("r") <= most)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("r", "draw_number", "said"))), lambda v: F.format_string("draw %d: %s", v["draw_number"], v["said"]))
    per = g.groupBy("game").agg(F.count(F.lit(1)).alias("both"), F.count_if(F.col("sets") > 1).alias("differ"), F.count_if(F.col("dates") > 1).alias("moved")).filter(F.col("both") >= least)
    per = per.join(F.broadcast(s.meta.select("game")), "game", "left_semi").join(bad.groupBy("game").agg(F.array_join(shown, "; ").alias("shown")), "game", "left")
    detail = F.concat_ws("; ", F.format_string("%d draws in several sources; %d differ in numbers, %d in date", "both", "differ", "moved"), "shown")
    return rows(per, "source_agreement", "overlapping draws", F.col("both"), F.col("differ"), None, F.col("differ") / F.col("both"), detail)


def repeat_sets_by_source(s: Slices) -> DataFrame:
    ordered = F.broadcast(s.games.filter("ordered").select(F.col("code").alias("game")))
    d = s.rows.join(ordered, "game", "left_anti").join(F.broadcast(s.meta.select("game")), "game", "left_semi")
    g = bt.repeat_sets_by_source(d)
    detail = F.format_string("%s: %d repeated sets in %d draws, %.2f expected", "source", "repeats", "draws", "expected")
    return rows(g, "repeat_sets_by_source", F.col("source"), F.col("draws"), F.col("repeats"), None, F.col("repeats") - F.col("expected"), detail, "poisson", F.col("repeats"), F.col("expected"))


def money_scale(s: Slices) -> DataFrame:
    """Jackpots of the two best sources against each other; a median far from 1 means a wrong unit."""
    if len(s.priority) < 2 or "jackpot_cents" not in s.raw.columns:
        return s.draws.sparkSession.createDataFrame([], COLUMNS)
    side = lambda i, name: s.rows.filter((F.col("source") == s.priority[i]) & (F.col("jackpot_cents") > 0)).select("game", "draw_number", F.col("jackpot_cents").alias(name))
    p = side(0, "x").join(side(1, "y"), ["game", "draw_number"]).select("game", (F.col("x") / F.col("y")).alias("ratio"))
    p = written(p, "ratios")  # read once for each level of the median
    near = p.groupBy("game").agg(F.count_if(F.abs(F.col("ratio") - 1) < 0.02).alias("near"))
    g = ranks.percentile(p, ["game"], "ratio", 0.5, "median").filter("n >= 5").join(near, "game")
    g = g.join(F.broadcast(s.meta.select("game")), "game", "left_semi")
    detail = F.format_string("%d draws with a jackpot in both; median ratio %.4f, %d within 2%%", "n", "median", "near")
    return rows(g, "money_scale_calibration", "jackpots of two sources", F.col("n"), F.col("median"), None, F.col("near") / F.col("n"), detail)


def pool_calibration(s: Slices) -> DataFrame:
    return rows(s.meta.filter("note IS NOT NULL"), "pool_calibration", "declared vs observed", F.col("draws"), detail=F.col("note"))


@dataclass(frozen=True)
class Test:
    """A test of the battery: a function of Slices, and whether it sees each era by itself."""

    name: str
    find: Callable[..., DataFrame]
    per_era: bool = False

    def run(self, s: Slices) -> DataFrame:
        """Result rows. A function that needs two arguments gets the draws that its flag names, too."""
        needed = [p for p in signature(self.find).parameters.values() if p.default is p.empty]
        return self.find(s, s.sliced if self.per_era else s.whole) if len(needed) > 1 else self.find(s)


#: Every registered test by name, in the order of registration.
REGISTRY: dict[str, Test] = {}


def register(find: Callable | None = None, *, per_era: bool = False, name: str | None = None):
    """Adds a test to the battery, as a call or as a decorator.

    per_era: its null depends on the size of the pool, so it sees each era's draws with the era's own pool,
    and its scopes get the era's tag; else it sees whole histories. A test `f(s, draws)` gets those draws as
    its second argument. It returns `rows(...)`; one that gives no law is descriptive.
    """
    if find is None:
        return lambda f: register(f, per_era=per_era, name=name)
    REGISTRY[name or find.__name__] = Test(name or find.__name__, find, per_era)
    return find


for _f in (pool_calibration, source_agreement, repeat_sets_by_source, money_scale):
    register(_f)
for _f in (pair_cooccurrence, consecutive_numbers, repeat_sets, lag_repeat, by_period, by_dow, by_era, rate_changepoint):
    register(_f, per_era=True)
for _f in (number_frequency, positional_frequency, bonus_frequency, autocorrelation, digit_tests, out_of_pool_values, jackpot_drop_inference, rollover_geometry, won_draw_low_numbers):
    register(_f)


def failed(spark, test: str, game: str | None, error: Exception) -> DataFrame:
    """The row that stands for a test that failed, of one game or of all (`*`)."""
    said = f"{type(error).__name__}: {error}".split("\n")[0][:300]
    return spark.createDataFrame([(game or "*", test, "failed", said)], "game string, test string, scope string, detail string").select(
        "game", "test", "scope", *[F.lit(None).cast(t).alias(c) for c, t in (("statistic", "double"), ("dof", "double"), ("n", "long"), ("effect", "double"))], "detail",
        *[F.lit(None).cast(t).alias(c) for c, t in (("law", "string"), ("x", "double"), ("a", "double"), ("b", "double"))], F.lit("failed").alias("status"),
    )


def attempted(test: Test, s: Slices) -> DataFrame:
    """The test's rows as a written table with a status.

    If it fails, it runs for each game by itself, so that only games that fail lose it: these get a row with
    status `failed` and the error as its detail.
    """
    keep = lambda df: written(df.withColumn("status", F.lit("ok")).coalesce(1), "results")
    spark = s.raw.sparkSession
    try:
        return keep(test.run(s))
    except Exception as whole:  # noqa: BLE001
        games, out = [r[0] for r in s.meta.select("game").orderBy("game").collect()], []  # one row for each game
        for game in games if len(games) > 1 else []:
            try:
                out.append(keep(test.run(s.only(game))))
            except Exception as e:  # noqa: BLE001
                out.append(failed(spark, test.name, game, e))
        return reduce(DataFrame.unionByName, out) if out else failed(spark, test.name, games[0] if games else None, whole)


def run(s: Slices, tests: Sequence | None = None, others: Sequence = (), at_once: int = 8) -> DataFrame:
    """All results with p- and q-values and a status; missing figures are null.

    Each test is a job of its own and its rows a table of their own, `at_once` of them at a time; one that
    fails leaves the others whole. False-discovery rates are taken over all results in the end. `tests` are names,
    Tests or functions of Slices (all that are registered if left out); `others` are functions without arguments or
    DataFrames that give result rows, as of winners.
    """
    def named(t) -> Test:
        return t if isinstance(t, Test) else REGISTRY[t] if isinstance(t, str) else next((r for r in REGISTRY.values() if r.find is t), Test(getattr(t, "__name__", "other"), t))

    due = [named(t) for t in (REGISTRY.values() if tests is None else tests)]
    for i, o in enumerate(others):
        due.append(Test(getattr(o, "__name__", f"other {i}"), lambda _, o=o: o if isinstance(o, DataFrame) else o()))
    s.prepare()
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        found = list(pool.map(lambda t: attempted(t, s), due))
    all_ = reduce(DataFrame.unionByName, found)
    # p-values of all results in one task each: they are a few hundred.
    p = F.when(F.col("law") == "given", F.col("x")).otherwise(tails.p_of("law", "x", "a", "b"))
    return op.benjamini_hochberg(all_.withColumn("p_value", p)).select("game", "test", "scope", "statistic", "dof", "p_value", "q_value", "n", "effect", "detail", "status")
