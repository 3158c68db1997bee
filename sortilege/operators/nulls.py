"""Nulls of the tests: simulated draws, and draws in random order in closed form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Simulations made at once, from one seed.
BATCH = 500


def simulated_counts(seed: list[int], sims: int, draws: int, pool: int, k: int) -> np.ndarray:
    """How often each of `pool` numbers comes in `draws` draws of k without replacement: a row for each simulation.

    Numbers are dealt one after another. Draws that still need j of the r numbers left hold the next one with
    probability j / r, each by itself, so their number that do is binomial: the joint law of the counts is
    exact, and its cost does not depend on the number of draws.
    """
    rng = np.random.default_rng(seed)
    need = np.zeros((sims, k + 1), np.int64)  # draws that still need j numbers
    need[:, k] = draws
    out, j = np.empty((sims, pool), np.int64), np.arange(k + 1)
    for v in range(pool):
        held = rng.binomial(need, np.minimum(1.0, j / (pool - v)))
        out[:, v] = held.sum(1)
        need -= held
        need[:, :-1] += held[:, 1:]
    return out


def simulated_chi2(seed: list[int], sims: int, draws: int, pool: int, k: int) -> np.ndarray:
    """Chi-square of the counts of each simulation against equal ones."""
    e = draws * k / pool
    return ((simulated_counts(seed, sims, draws, pool, k) - e) ** 2 / e).sum(1)


def with_frequency_p(stats: DataFrame, sims: int = 3000, seed: int = 1) -> DataFrame:
    """Adds mc_p to rows (game, chi2, n, pool, k): (hits + 1) / (sims + 1) of simulations that reach chi2.

    Each batch of simulations has a seed of its own, so results depend neither on partitions
    nor on which other rows there are. Null for k = 1 and where k fills the pool.
    """
    due = stats.filter((F.col("k") > 1) & (F.col("pool") > F.col("k")) & (F.col("n") > 0))
    batches = F.explode(F.sequence(F.lit(0), F.lit((sims - 1) // BATCH)))
    asked = due.select("game", F.col("chi2").cast("double"), F.col("n").cast("long"), F.col("pool").cast("int"), F.col("k").cast("int"), batches.alias("batch"))

    def run(rows):
        for b in rows:
            hit = []
            for chi2, n, pool, k, i in zip(*(b.column(x).to_pylist() for x in range(1, 6))):
                made = simulated_chi2([seed, i, n, pool, k], min(BATCH, sims - i * BATCH), n, pool, k)
                hit.append(int((made >= chi2 - 1e-9).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hit, pa.int64())], ["game", "hit"])

    hits = asked.repartition("game", "batch").mapInArrow(run, "game string, hit long").groupBy("game").agg(((F.sum("hit") + 1) / (sims + 1)).alias("p_"))
    return stats.join(hits, "game", "left").withColumnRenamed("p_", "mc_p")


def order_null(draws: DataFrame) -> DataFrame:
    """game, n, pair_mean, pair_variance: of the numbers that two draws of a game share when the order of its draws is random.

    Over all pairs of different draws the shared numbers a have the mean of c (c - 1)
    over numbers drawn c times, and their squares that of pairs of numbers. A draw's
    own tendency u to share adds up to the same in any order but for the ends, so the
    sum over neighbours varies by a - u - u' alone: Var(a) - 2 Var(u) for each pair.
    """
    n = draws.groupBy("game").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    long = draws.select("game", "numbers", F.explode("numbers").alias("b"))
    c = long.groupBy("game", "b").agg(F.count(F.lit(1)).alias("c"))
    pairs = long.select("game", "b", F.explode("numbers").alias("d")).groupBy("game", "b", "d").agg(F.count(F.lit(1)).alias("c"))
    ways = F.col("n") * (F.col("n") - 1.0)
    one = c.groupBy("game").agg(F.sum(F.col("c") * (F.col("c") - 1.0)).alias("s1"))
    two = pairs.groupBy("game").agg(F.sum(F.col("c") * (F.col("c") - 1.0)).alias("s2"))
    # Pool-sized counts of each game travel as one map, so that draws are not exploded and summed again.
    counts = c.groupBy("game").agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("counts")).join(n, "game")
    u = F.aggregate("numbers", F.lit(0.0), lambda acc, b: acc + (F.try_element_at("counts", b) - 1) / (F.col("n") - 1))
    spread = draws.join(F.broadcast(counts), "game").select("game", u.alias("u")).groupBy("game").agg(F.var_pop("u").alias("var_u"))
    g = n.join(one, "game").join(two, "game").join(spread, "game").withColumn("pair_mean", F.col("s1") / ways)
    variance = F.col("s2") / ways - F.col("pair_mean") * F.col("pair_mean") - 2 * F.col("var_u")
    return g.select("game", "n", "pair_mean", F.greatest(variance, F.lit(0.0)).alias("pair_variance"))
