"""The draw table that the tests read: sources merged, pools taken from the data, histories split where the pool changed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import fitting, written
from .sequence import STRETCH, sequence, stretches

#: Filled from another source where the best one has none; all else is the best source's own.
GAP_FILLED = ("jackpot_cents", "wins", "multiplier", "draw_time", "draw_period", "promo")
#: Draws of a segment that counts as an era, of a block that is kept, and uses of a number that make it one of the pool.
ERA_DRAWS, BLOCK_DRAWS, USES = 200, 100, 3
#: Widest half of the rolling window.
WIDEST = 200


def is_placeholder(numbers: Column) -> Column:
    """A row of zeros alone stands for a draw whose result is missing."""
    return (F.size(numbers) > 0) & F.forall(numbers, lambda x: x == 0)


def drop_placeholders(draws: DataFrame, zero_games: Sequence[str] = ()) -> DataFrame:
    """Without rows of zeros; games named in zero_games have a zero in their pool and keep theirs."""
    return draws.filter(~is_placeholder(F.col("numbers")) | F.col("game").isin(*zero_games))


def with_rows(draws: DataFrame) -> DataFrame:
    """Adds `rows_`, how many rows a row's game and draw number have; rows without a number are dealt by all that they hold."""
    spread = F.when(F.col("draw_number").isNull(), F.xxhash64(*draws.columns))
    return draws.withColumn("rows_", F.count(F.lit(1)).over(Window.partitionBy("game", "draw_number", spread)))


def load_draws(draws: DataFrame, priority: Sequence[str], zero_games: Sequence[str] = ()) -> DataFrame:
    """One row per game and draw number.

    The best source by `priority` (unnamed ones last, by name) gives the row; the
    GAP_FILLED figures that it lacks come from the next that has them. Placeholders
    go first, so that they never win; rows without number or date are left out.
    Where draws have `rows_` (see `with_rows`), only rows that are not alone meet others.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("source")), F.lit(0))
    d = drop_placeholders(draws, zero_games).filter(F.col("draw_number").isNotNull() & F.col("draw_date").isNotNull())
    own = [c for c in draws.columns if c not in ("game", "draw_number", "source", "rows_", *GAP_FILLED)]
    filled = [c for c in draws.columns if c in GAP_FILLED]
    several = d.filter("rows_ > 1") if "rows_" in draws.columns else d
    several = several.withColumn("at_", F.struct(F.when(rank > 0, rank).otherwise(len(priority) + 1).alias("r"), F.col("source").alias("s")))
    label = F.array_join(F.transform(F.array_sort(F.collect_set("at_")), lambda x: x["s"]), "+")
    got = several.groupBy("game", "draw_number").agg(
        F.min_by(F.struct(*own), "at_").alias("own_"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at_"))).alias(c) for c in filled], label.alias("source")
    )
    got = got.select("game", "draw_number", "own_.*", *filled, "source")
    if "rows_" not in draws.columns:
        return got
    return got.unionByName(d.filter("rows_ = 1").withColumn("source", F.coalesce("source", F.lit(""))).select(got.columns))


def supported(draws: DataFrame, value: str = "number", keys: Sequence[str] = ("game",)) -> DataFrame:
    """keys, low, high: the range of values used USES times or more, or of all if none is."""
    seen = draws.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    often = F.when(F.col("c") >= USES, F.col(value))
    return seen.groupBy(*keys).agg(F.coalesce(F.min(often), F.min(value)).alias("low"), F.coalesce(F.max(often), F.max(value)).alias("high"))


def with_tops(seq: DataFrame, draws: DataFrame) -> DataFrame:
    """Adds `low` and `high`, a draw's least and greatest number of those that draws use USES times or more, and `top`: high, or the least of these if it has none."""
    uses = draws.select("game", F.explode("numbers").alias("x")).groupBy("game", "x").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= USES)
    pool = written(uses.groupBy("game").agg(F.sort_array(F.collect_list("x")).alias("used")), "pools")  # one row for each game, as long as a pool
    own = F.filter("numbers", lambda v: F.array_contains("used", v))
    x = seq.join(F.broadcast(pool), "game").withColumn("own", own)
    return x.withColumns({"low": F.array_min("own"), "high": F.array_max("own")}).withColumn("top", F.coalesce("high", F.array_min("used"))).drop("own", "used")


def centred_max(x: np.ndarray, half: int) -> np.ndarray:
    """The greatest of x from `half` places before each to `half` behind, from running maxima of blocks as wide as that window, forwards and backwards."""
    wide = 2 * half + 1
    y = np.full(-(-(len(x) + 2 * half) // wide) * wide, x.min())
    y[half : half + len(x)] = x
    y = y.reshape(-1, wide)
    upto, back = np.maximum.accumulate(y, 1).ravel(), np.maximum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.maximum(back[: len(x)], upto[2 * half : 2 * half + len(x)])


def rolling_runs(seq: DataFrame, size: int = STRETCH) -> DataFrame:
    """Of a sequence with `top`: game, stretch, run, roll, top, a, z.

    `roll` is the greatest top among the draws near a draw; the window follows the game's length. A run is what lies in one stretch of
    draws of equal roll, and a and z are the first and the last draw of each top in it. A task sees a stretch and copies of its neighbours.
    """
    def runs(key, table):
        nth, top, home, n = (table.column(c).to_numpy() for c in ("nth", "top", "home", "n"))
        order = np.argsort(nth)
        nth, top, home = nth[order], top[order], home[order]
        half = max(60, min(WIDEST * 2, int(n[0]) // 12)) // 2
        nth, roll, top = nth[home], centred_max(top, half)[home], top[home]
        run = np.concatenate([[0], np.cumsum(roll[1:] != roll[:-1])])
        by = np.lexsort((top, run))  # draws of a run and top stay in order
        new = np.flatnonzero((np.diff(run[by]) != 0) | (np.diff(top[by]) != 0)) + 1
        first, last = by[np.concatenate([[0], new])], by[np.concatenate([new - 1, [len(by) - 1]])]
        many = len(first)
        return pa.table([pa.array([key[0].as_py()] * many, pa.string()), pa.array([key[1].as_py()] * many, pa.int64()), run[first], roll[first].astype(np.int32), top[first].astype(np.int32), nth[first], nth[last]], ["game", "stretch", "run", "roll", "top", "a", "z"])

    x = stretches(seq.select("game", "nth", "n", F.col("top").cast("int").alias("top")), WIDEST, WIDEST, size)
    return x.groupBy("game", "stretch").applyInArrow(runs, "game string, stretch long, run long, roll int, top int, a long, z long")


def numbered_runs(runs: DataFrame) -> DataFrame:
    """Runs with `segment` (1, 2, ...): runs of one roll that meet at the border of two stretches are one segment."""
    w = Window.partitionBy("game").orderBy("first")  # one row for each run of a stretch
    one = runs.groupBy("game", "stretch", "run").agg(F.max("roll").alias("roll"), F.min("a").alias("first"))
    new = F.coalesce((F.col("roll") != F.lag("roll").over(w)).cast("int"), F.lit(1))
    one = one.withColumn("new_", new).withColumn("segment", F.sum("new_").over(w)).select("game", "stretch", "run", "segment")
    return runs.join(one, ["game", "stretch", "run"])


def folded(g: pd.DataFrame, least: int) -> list[list]:
    """[roll, first, last, segments] of a game's segments, those of fewer than `least` draws joined to the one before, if there is one."""
    kept: list[list] = []
    for r in g.sort_values("segment").itertuples():
        if kept and r.last - r.first + 1 < least:
            kept[-1][2] = r.last
            kept[-1][3].append(r.segment)
        else:
            kept.append([r.roll, r.first, r.last, [r.segment]])
    return kept


def moved(parts: list[list], extremes: dict[int, list[tuple[int, int, int]]]) -> list[list[int]]:
    """[first, last] of folded segments after each border is moved to the very draw at which the greater number first or last occurs.

    extremes[i]: (top, first draw, last draw) of each top that occurs in segment i. They tell the first and the
    last draw above a bar within whole segments, and that is all that is asked for, though a border is looked for from
    the moved start of the segment before it. For a last draw only the start bounds it. For a first draw: behind a border
    that was moved to where the greater number ends, no draw up to the next segment lies above the same bar;
    behind one that was moved to where a greater number begins, no draw before that lies above a higher bar.
    """
    spans = [[first, last] for _, first, last, _ in parts]
    base = 0  # the first draw above a bar is looked for from this segment on
    for i in range(1, len(parts)):
        bar, rising = min(parts[i - 1][0], parts[i][0]), parts[i][0] > parts[i - 1][0]
        start = None
        if rising:
            for m in range(base, i + 1):
                above = [a for top, a, _ in extremes.get(m, ()) if top > bar]
                if above:
                    start = min(above)
                    break
        else:
            for m in range(i, -1, -1):
                above = [z for top, _, z in extremes.get(m, ()) if top > bar]
                if above or parts[m][1] <= spans[i - 1][0]:
                    start = max(above) + 1 if above and max(above) >= spans[i - 1][0] else None
                    break
        if start is not None and spans[i - 1][0] < start <= spans[i][1]:
            spans[i - 1][1], spans[i][0] = start - 1, start
            base = base if rising else i + 1
        else:
            base = i
    return spans


def pool_eras(draws: DataFrame, least: int = ERA_DRAWS) -> DataFrame:
    """Stretches of a game's history with one pool: game, era (0, 1, ...), label, pool_min, pool_max, first, last (nth).

    Segments of equal rolling maximum, the short ones folded into the one before;
    each border is moved to the very draw at which the greater number first or last
    occurs; neighbours that end up with equal pools are one era, which may then have
    several rows. Games with one era only, or fewer than 2 * least draws, have none.
    One plan for all borders of all games: a task sees a game's segments and, for each, the first and the last
    draw of every top, which are at most as many as the pool has numbers.
    """
    held = draws.filter((F.size("numbers") > 0) & F.col("draw_date").isNotNull() & F.col("draw_number").isNotNull()).select("game", "draw_date", "draw_number", "numbers")
    seq = sequence(held).filter(F.col("n") >= 2 * least)
    tops = written(with_tops(seq, held).select("game", "draw_date", "nth", "n", "low", "high", "top"), "tops")
    segments = written(numbered_runs(written(rolling_runs(tops), "runs")), "segments")
    ends = segments.groupBy("game", "segment").agg(F.max("roll").alias("roll"), F.min("a").alias("first"), F.max("z").alias("last"))
    extremes = segments.groupBy("game", "segment", "top").agg(F.min("a").alias("a"), F.max("z").alias("z"))

    def borders(g: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        parts = folded(g, least) if len(g) else []
        out = []
        if len(parts) > 1:
            of = {segment: i for i, p in enumerate(parts) for segment in p[3]}
            known: dict[int, list] = {}
            for r in x.itertuples():
                known.setdefault(of[r.segment], []).append((r.top, r.a, r.z))
            out = [(g["game"].iloc[0], k, a, z) for k, (a, z) in enumerate(moved(parts, known))]
        return pd.DataFrame(out, columns=["game", "block", "first", "last"])

    blocks = ends.groupBy("game").cogroup(extremes.groupBy("game")).applyInPandas(borders, "game string, block int, first long, last long")
    blocks = written(blocks, "blocks")
    # Draws look for their block among those that touch their stretch.
    at = lambda nth: F.floor((nth - 1) / STRETCH)
    spans = blocks.select("game", "first", "last", F.explode(F.sequence(at(F.col("first")), at(F.col("last")))).alias("stretch"))
    spans = spans.groupBy("game", "stretch").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    own = F.get(F.filter("spans", lambda s: F.col("nth").between(s["first"], s["last"])), F.lit(0))["first"]
    inside = tops.withColumn("stretch", at(F.col("nth"))).join(fitting(written(spans, "spans")), ["game", "stretch"])
    found = inside.groupBy("game", own.alias("block")).agg(
        F.min("nth").alias("first"), F.max("nth").alias("last"), F.min("low").alias("lo"), F.max("high").alias("hi"), F.min("draw_date").cast("string").alias("d0"), F.max("draw_date").cast("string").alias("d1")
    ).filter((F.col("lo").isNotNull()) & (F.col("last") - F.col("first") + 1 >= BLOCK_DRAWS))

    def joined(g: pd.DataFrame) -> pd.DataFrame:
        eras: list[list] = []
        for r in g.sort_values("first").itertuples():
            if eras and eras[-1][:2] == [r.lo, r.hi]:
                eras[-1][3] = r.d1
                eras[-1][4].append((r.first, r.last))
            else:
                eras.append([r.lo, r.hi, r.d0, r.d1, [(r.first, r.last)]])
        out = [(g["game"].iloc[0], k, f"{d0}..{d1}", lo, hi, a, z) for k, (lo, hi, d0, d1, spans) in enumerate(eras) for a, z in spans if len(eras) > 1]
        return pd.DataFrame(out, columns=["game", "era", "label", "pool_min", "pool_max", "first", "last"])

    return found.groupBy("game").applyInPandas(joined, "game string, era int, label string, pool_min int, pool_max int, first long, last long")


def game_meta(draws: DataFrame, games: DataFrame, eras: DataFrame) -> DataFrame:
    """One row per game of draws: pool_min, pool_max, bonus_min, bonus_max, picks, draws, ordered, has_jackpot, bonus_name, note.

    games (code, pool_min, pool_max, bonus_name, bonus_pool_min, bonus_pool_max,
    ordered, has_jackpot) declares pools; those that the data use win, and the note
    says so. The last era's pool is the present one. Of equally frequent numbers of
    picks the one seen first counts.
    """
    pool = supported(draws.select("game", F.explode("numbers").alias("number")))
    k = draws.groupBy("game", F.size("numbers").alias("picks")).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("draw_date", "draw_number")).alias("seen"))
    k = k.groupBy("game").agg(F.min_by("picks", F.struct(-F.col("c"), "seen")).alias("picks"), F.sum("c").alias("draws"))
    known = games.select(F.col("code").alias("game"), F.col("pool_min").alias("d_min"), F.col("pool_max").alias("d_max"), "bonus_name", "bonus_pool_min", "bonus_pool_max", "ordered", "has_jackpot")
    own = "bonus_number" if "bonus_number" in draws.columns else F.lit(None).cast("int")
    bonus = supported(draws.select("game", F.col(own).alias("number") if isinstance(own, str) else own.alias("number")).filter("number IS NOT NULL"))
    bonus = bonus.select("game", F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    e = eras.groupBy("game").agg(F.max_by(F.struct("pool_min", "pool_max"), "era").alias("now"), F.countDistinct("era").alias("eras"))
    said = F.transform(F.array_sort(F.collect_set(F.struct("era", "label", "pool_min", "pool_max"))), lambda x: F.format_string("%s %d-%d", x["label"], x["pool_min"], x["pool_max"]))
    e = e.join(eras.groupBy("game").agg(F.array_join(said, "; ").alias("said")), "game")
    m = k.join(pool, "game", "left").join(known, "game", "left").join(bonus, "game", "left").join(e, "game", "left")
    has_bonus = F.col("bonus_name").isNotNull() & F.col("b_low").isNotNull()
    differs = lambda a, b, c, d: ~(F.col(a).eqNullSafe(F.col(c)) & F.col(b).eqNullSafe(F.col(d)))
    span = lambda a, b: F.concat(F.coalesce(F.col(a).cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col(b).cast("string"), F.lit("?")))
    main = F.when(F.col("low").isNotNull() & differs("low", "high", "d_min", "d_max"), F.concat(F.lit("main pool "), span("low", "high"), F.lit(" in the data, declared "), span("d_min", "d_max")))
    side = F.when(has_bonus & differs("b_low", "b_high", "bonus_pool_min", "bonus_pool_max"), F.concat("bonus_name", F.lit(" pool "), span("b_low", "b_high"), F.lit(" in the data, declared "), span("bonus_pool_min", "bonus_pool_max")))
    note = F.concat_ws("; ", main, side, F.when(F.col("eras") > 1, F.concat(F.lit("pool changed: "), F.col("said"))))
    return m.select(
        "game", F.coalesce("now.pool_min", "low", "d_min").alias("pool_min"), F.coalesce("now.pool_max", "high", "d_max").alias("pool_max"),
        F.when(has_bonus, F.col("b_low")).otherwise(F.col("bonus_pool_min")).alias("bonus_min"), F.when(has_bonus, F.col("b_high")).otherwise(F.col("bonus_pool_max")).alias("bonus_max"),
        "picks", "draws", F.coalesce("ordered", F.lit(False)).alias("ordered"), F.coalesce("has_jackpot", F.lit(False)).alias("has_jackpot"), "bonus_name", F.when(note != "", note).alias("note"),
    )


def era_slices(draws: DataFrame, meta: DataFrame, eras: DataFrame) -> DataFrame:
    """The draws with their game's meta and the pool that they belong to; `tag` names the era, and is empty where there is one only.

    `title` keeps the game's name and `game` names the slice, so that windows see each slice as a sequence.
    """
    x = draws.join(F.broadcast(meta), "game")
    ranges = eras.select(F.col("game").alias("e_game"), "label", F.col("pool_min").alias("e_min"), F.col("pool_max").alias("e_max"), "first", "last")
    split = F.broadcast(eras.select("game").distinct())
    plain = x.join(split, "game", "left_anti").withColumn("tag", F.lit(""))
    seq = sequence(draws.filter(F.size("numbers") > 0).join(split, "game", "left_semi")).drop("n")
    cut = seq.join(F.broadcast(ranges), (F.col("game") == F.col("e_game")) & F.col("nth").between(F.col("first"), F.col("last")))
    cut = cut.join(F.broadcast(meta.drop("pool_min", "pool_max")), "game").withColumnsRenamed({"e_min": "pool_min", "e_max": "pool_max"})
    cut = cut.withColumn("tag", F.format_string("pool %d-%d, %s", "pool_min", "pool_max", "label"))
    both = plain.unionByName(cut.select(plain.columns))
    return both.withColumn("title", F.col("game")).withColumn("game", F.concat_ws("|", "title", F.when(F.col("tag") != "", F.col("tag"))))
