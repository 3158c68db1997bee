"""Fits and tests over histograms: geometric run lengths, Wald-Wolfowitz runs, gaps between recurrences."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import kolmogorov_sf
from .sequence import islands, neighbours, sequence


#: Runs expected in a cell of a histogram at least, and runs of a game that is fitted.
CELL_RUNS, LEAST_RUNS = 5, 10


def cells(runs: int, rate: float, longest: int) -> list[tuple[int, int]]:
    """Cells (over a, up to b) of run lengths, each as short as CELL_RUNS expected runs allow; the last one reaches to the longest run.

    Under the law, runs * (1 - rate) ** a are longer than a, so the end of a cell follows from its beginning.
    """
    left, out = 1 - rate, []
    if left <= 0:
        return [(0, longest)]
    while not out or out[-1][1] < longest:
        a = out[-1][1] if out else 0
        rest = left**a - CELL_RUNS / runs
        b = max(a + 1, math.ceil(math.log(rest) / math.log(left) - 1e-9)) if rest > 0 else longest + 1
        if b > longest:
            break
        out.append((a, b))
    return [*out[:-1], (out[-1][0], longest)] if out else []


def geometric_fit(histogram: DataFrame) -> DataFrame:
    """game, p_hat, chi2, dof, runs of run lengths (game, length, runs), for games of LEAST_RUNS runs or more.

    The rate is runs over draws. Cells follow from the law alone, one row for each; runs meet them by length in Spark,
    and expected runs are scaled to those that the cells hold. Fewer than three cells give no test.
    """
    per = histogram.groupBy("game").agg(F.sum("runs").alias("n"), F.sum(F.col("length") * F.col("runs")).alias("draws"), F.max("length").alias("longest"))
    per = per.filter(F.col("n") >= LEAST_RUNS).withColumn("p_hat", F.col("n") / F.col("draws"))

    def dealt(frames):
        for f in frames:
            rows = [(r.game, k, a, b, r.n * ((1 - r.p_hat) ** a - (1 - r.p_hat) ** b)) for r in f.itertuples() for k, (a, b) in enumerate(cells(int(r.n), float(r.p_hat), int(r.longest)))]
            yield pd.DataFrame(rows, columns=["game", "cell", "over", "upto", "due"])

    due = per.select("game", "n", "p_hat", "longest").mapInPandas(dealt, "game string, cell int, over long, upto long, due double")
    h = histogram.withColumnRenamed("runs", "c")
    seen = due.join(h, "game").groupBy("game", "cell").agg(F.max("due").alias("due"), F.sum(F.when((F.col("length") > F.col("over")) & (F.col("length") <= F.col("upto")), F.col("c")).otherwise(0)).alias("o"))
    sums = seen.groupBy("game").agg(F.count(F.lit(1)).alias("k"), F.sum("due").alias("all_due"), F.sum("o").alias("all_o"), F.sum(F.col("o") * F.col("o") / F.col("due")).alias("s"))
    # With expected runs scaled by f, the sum of (o - f e)^2 / (f e) is the sum of o^2 / e over f, less all of o.
    chi2 = F.col("s") * F.col("all_due") / F.col("all_o") - F.col("all_o")
    tested = F.col("k") >= 3
    return per.join(sums, "game", "left").select("game", "p_hat", F.when(tested, chi2).alias("chi2"), F.when(tested, F.col("k") - 2).cast("int").alias("dof"), F.col("n").alias("runs"))


def runs_test(draws: DataFrame, flag: Column) -> DataFrame:
    """game, n, runs, z of the Wald-Wolfowitz test of a yes-no series of 20 draws or more; the p-value is twice the normal tail of z."""
    seq = sequence(draws.withColumn("f_", flag.cast("int")))
    per = seq.groupBy("game").agg(F.count(F.lit(1)).alias("n"), F.sum("f_").alias("n1")).withColumn("n0", F.col("n") - F.col("n1")).filter("n >= 20 AND n1 > 0 AND n0 > 0")
    g = islands(seq, "f_").groupBy("game").agg(F.count(F.lit(1)).alias("runs")).join(per, "game")
    both = 2.0 * F.col("n1") * F.col("n0")
    mean, variance = both / F.col("n") + 1, both * (both - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    return g.filter(variance > 0).select("game", "n", "runs", ((F.col("runs") - mean) / F.sqrt(variance)).alias("z"))


def gap_test(draws: DataFrame, number: int, pool: int, least: int = 30) -> DataFrame:
    """game, gaps, mean_gap, ks: the largest distance of the gaps between draws of a number from the geometric law of 1 / pool.

    The limit law of root n times it is `kolmogorov_sf`. Gaps meet in a histogram first.
    """
    hits = sequence(draws).filter(F.array_contains("numbers", number)).select("game", "draw_date", "draw_number", F.col("nth").alias("at"))
    gaps = neighbours(sequence(hits), {"was": ("at", 1)}).filter("was IS NOT NULL")
    h = gaps.groupBy("game", (F.col("at") - F.col("was")).alias("gap")).agg(F.count(F.lit(1)).alias("c"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("gap")
        gap, c = g["gap"].to_numpy(float), g["c"].to_numpy(float)
        n, upto = c.sum(), np.cumsum(c)
        law = 1 - (1 - 1 / pool) ** gap
        ks = max(float((upto / n - law).max()), float((law - (upto - c) / n).max()))
        return pd.DataFrame({"game": [g["game"].iloc[0]], "gaps": [int(n)], "mean_gap": [(gap * c).sum() / n], "ks": [ks], "p_value": [kolmogorov_sf(ks * math.sqrt(n))]})

    return h.groupBy("game").applyInPandas(fit, "game string, gaps long, mean_gap double, ks double, p_value double").filter(F.col("gaps") >= least)
