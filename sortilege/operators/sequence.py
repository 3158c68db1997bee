"""Windows over a game's draws in order, dealt by stretches of the sequence and not by whole games.

A game may hold a third of all rows, so no window is partitioned by game alone.
Rows are numbered from counts of each date; the numbers deal a game into stretches
of bounded length. A window that looks at its neighbours gets copies of the rows just
outside its stretch; a running sum adds the sums of the stretches before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Draws of a game in one stretch.
STRETCH = 50_000


def sequence(draws: DataFrame) -> DataFrame:
    """Adds nth (1, 2, ... by date and number) and n, the number of the game's draws. Rows without a date or number are left out."""
    rows = draws.drop("nth", "n").filter(F.col("draw_date").isNotNull() & F.col("draw_number").isNotNull())
    days = rows.groupBy("game", "draw_date").agg(F.count(F.lit(1)).alias("c"))
    # One row for each game and date.
    game = Window.partitionBy("game")
    before = game.orderBy("draw_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("game", "draw_date", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(game).alias("n"))
    own = F.row_number().over(Window.partitionBy("game", "draw_date").orderBy("draw_number"))
    return rows.withColumn("own", own).join(days, ["game", "draw_date"]).withColumn("nth", F.col("base") + F.col("own")).drop("base", "own")


def stretches(seq: DataFrame, before: int | Column = 0, after: int | Column = 0, size: int = STRETCH) -> DataFrame:
    """Adds `stretch`, and `home`: true for a stretch's own rows, false for copies of up to `before` rows ahead of it and `after` behind it."""
    before, after = (x if isinstance(x, Column) else F.lit(x) for x in (before, after))
    first = F.greatest(F.lit(0), F.floor((F.col("nth") - 1 - after) / size))
    last = F.least(F.floor((F.col("n") - 1) / size), F.floor((F.col("nth") - 1 + before) / size))
    x = seq.withColumn("stretch", F.explode(F.sequence(first, last)))
    return x.withColumn("home", F.col("stretch") == F.floor((F.col("nth") - 1) / size))


def in_stretch() -> Window:
    return Window.partitionBy("game", "stretch").orderBy("nth")


def neighbours(seq: DataFrame, columns: dict[str, tuple[str, int]], size: int = STRETCH) -> DataFrame:
    """Adds for each name the column's value `step` draws earlier (later if below 0); null over an end."""
    steps = [step for _, step in columns.values()]
    x = stretches(seq, max(0, *steps), max(0, *(-s for s in steps)), size)
    return x.withColumns({name: F.lag(c, step).over(in_stretch()) for name, (c, step) in columns.items()}).filter("home").drop("home", "stretch")


def running(seq: DataFrame, value: Column, name: str, size: int = STRETCH) -> DataFrame:
    """Adds the sum of value over the game's draws up to this one."""
    x = stretches(seq.withColumn("v_", value), size=size)
    sums = x.groupBy("game", "stretch").agg(F.sum("v_").alias("s_"))
    earlier = Window.partitionBy("game").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("game", "stretch", F.coalesce(F.sum("s_").over(earlier), F.lit(0)).alias("b_"))
    inside = in_stretch().rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("own_", F.coalesce(F.sum("v_").over(inside), F.lit(0)))
    return x.join(sums, ["game", "stretch"]).withColumn(name, F.col("b_") + F.col("own_")).drop("v_", "own_", "b_", "stretch", "home")


def numbered_islands(seq: DataFrame, value: str, size: int = STRETCH) -> DataFrame:
    """Adds `segment` (1, 2, ...), the run of draws with equal values that each draw is in."""
    x = neighbours(seq, {"was_": (value, 1)}, size)
    new = (~F.col(value).eqNullSafe(F.col("was_")) | (F.col("nth") == 1)).cast("int")
    return running(x, new, "segment", size).drop("was_")


def islands(seq: DataFrame, value: str, size: int = STRETCH) -> DataFrame:
    """Runs of draws with equal values: game, segment (1, 2, ...), value, first, last (nth)."""
    return numbered_islands(seq, value, size).groupBy("game", "segment").agg(F.max(value).alias(value), F.min("nth").alias("first"), F.max("nth").alias("last"))
