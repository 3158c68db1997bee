"""Draw records from nested JSON: items of a paged web interface, as files of one item a line or of arrays.

Fetching is left to what fills the folder; a page or a date window is a file, and
Spark reads files side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse

ITEM = "id long, slug string, date string, link string, acf string"
#: Columns of a draw record.
RECORD = ["game", "draw_number", "draw_date", "draw_time", "draw_period", "dow", "numbers", "bonus_number", "multiplier", "jackpot_cents", "wins", "promo", "source", "source_url", "raw"]


@dataclass(frozen=True)
class Layout:
    """Where a game's numbers lie within `acf`: `group` and its `keys` (all number_N in order where none), or one number at `value`."""

    game: str
    group: str
    keys: tuple[str, ...] = ()
    value: bool = False
    digits: int = 0
    bonus: str | None = None
    multipliers: tuple[str, ...] = ()
    flag: str | None = None
    second: tuple[str, str, int] | None = None


# The games' paths, and the second draw (code, group, picks) that an item may hold.
LAYOUTS = [
    Layout("lotto", "lotto_winning_numbers", bonus="power_ball", multipliers=("multiplier_", "multiplier")),
    Layout("playwhe", "play_whe_winning_numbers", ("winning_number",), second=("playwhe_jackpot", "play_whe_jackpot_winning_numbers", 5)),
    Layout("pick2", "pick_2_winning_numbers", ("number_1", "number_2"), flag="mega_ball"),
    Layout("pick4", "pick_4_winning_numbers", value=True, digits=4),
    Layout("cashpot", "cash_pot_winning_numbers", multipliers=("multiplier",)),
    Layout("winforlife", "win_for_life_winning_numbers", bonus="cash_ball"),
    Layout("fastcash", "fast_cash_winning_numbers", ("winning_number",), second=("fastcash_jackpot", "fast_cash_jackpot_winning_numbers", 4)),
]
BY_GAME = {x.game: x for x in LAYOUTS}


def items(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """Items of the files at path: each holds a JSON array (a page), or an item a line. An error object instead of a page gives no items."""
    if not array:
        return spark.read.schema(ITEM).json(path)
    pages = spark.read.text(path, wholetext=True)
    return pages.select(F.explode(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':') for c in ITEM.split(', '))}>>")).alias("i")).filter("i IS NOT NULL").select("i.*")


def _at(path: str) -> Column:
    return F.get_json_object("acf", f"$.{path}")


def group_numbers(group: str, keys: tuple[str, ...] = ()) -> Column:
    """The whole numbers of a group, in the order of keys or of the N of its number_N."""
    m = F.from_json(_at(group), "map<string,string>")
    if keys:
        found = F.array(*[parse.integer(F.try_element_at(m, F.lit(k))) for k in keys])
    else:
        own = F.filter(F.map_entries(m), lambda e: e["key"].rlike(r"^number_\d+$"))
        ranked = F.array_sort(F.transform(own, lambda e: F.struct(F.regexp_extract(e["key"], r"(\d+)$", 1).cast("int").alias("n"), parse.integer(e["value"]).alias("v"))))
        found = F.transform(ranked, lambda e: e["v"])
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast("array<int>"))


def _numbers(x: Layout) -> Column:
    if not x.value:
        return group_numbers(x.group, x.keys)
    n = parse.integer(_at(x.group))
    digits = F.transform(F.split(F.lpad(n.cast("string"), x.digits, "0"), ""), lambda d: d.cast("int"))
    return F.coalesce(F.when(n >= 0, F.filter(digits, lambda d: d.isNotNull())), F.array().cast("array<int>"))


def draw_number() -> Column:
    return parse.integer(F.regexp_replace(F.coalesce("slug", F.lit("")), r"-\d+$", "")).cast("long")


def records(items: DataFrame, game: str, source: str) -> DataFrame:
    """Draw records of one game's items; an item without numbers has none, one with a second draw has two."""
    x = BY_GAME[game]
    time = parse.clock(_at("draw_time"))
    base = items.select(
        draw_number().alias("draw_number"), parse.either_date(_at("draw_date"), F.substring("date", 1, 10).try_cast("date")).alias("draw_date"), time.alias("draw_time"), parse.period(time).alias("draw_period"),
        parse.cents_of_thousandths(_at("jackpot")).alias("jackpot_cents"), F.lit(None).cast("int").alias("wins"), F.lit(source).alias("source"), F.col("link").alias("source_url"),
        F.to_json(F.struct("slug", F.col("date").alias("post_date"), "acf")).alias("raw"), _numbers(x).alias("main"), (parse.integer(_at(f"{x.group}.{x.bonus}")) if x.bonus else F.lit(None).cast("int")).alias("bonus"),
        (F.nullif(F.coalesce(*[F.nullif(_at(f"{x.group}.{m}"), F.lit("")) for m in x.multipliers]), F.lit("false")) if x.multipliers else F.lit(None).cast("string")).alias("times"),
        (F.concat(F.lit(f"{x.flag}="), parse.integer(_at(f"{x.group}.{x.flag}")).cast("string")) if x.flag else F.lit(None).cast("string")).alias("promo"),
        (group_numbers(x.second[1]) if x.second else F.array().cast("array<int>")).alias("second"),
    ).filter(F.size("main") > 0)
    kinds = [F.struct(F.lit(game).alias("game"), F.col("main").alias("numbers"), F.col("bonus").alias("bonus_number"), F.col("times").alias("multiplier"))]
    if x.second:
        code, _, picks = x.second
        other = F.struct(F.lit(code).alias("game"), F.col("second").alias("numbers"), F.lit(None).cast("int").alias("bonus_number"), F.lit(None).cast("string").alias("multiplier"))
        kinds.append(F.when(F.size("second") == picks, other))
    both = base.withColumn("d", F.explode(F.filter(F.array(*kinds), lambda k: k.isNotNull())))
    return both.withColumn("dow", F.weekday("draw_date").cast("int")).select("d.game", "draw_number", "draw_date", "draw_time", "draw_period", "dow", "d.numbers", "d.bonus_number", "d.multiplier", "jackpot_cents", "wins", "promo", "source", "source_url", "raw")


def forward_estimates(items: DataFrame, game: str, source: str) -> DataFrame:
    """game, draw_number, jackpot_cents, kind, source of the figures announced for coming draws."""
    x = items.select(F.lit(game).alias("game"), draw_number().alias("draw_number"), parse.cents_of_thousandths(_at("current_jackpot")).alias("jackpot_cents"), F.lit("current").alias("kind"), F.lit(source).alias("source"))
    return x.filter("draw_number IS NOT NULL")


def windows(first: Column, last: Column, days: int = 7) -> Column:
    """Date windows (after, before) that cover first to last, by which deep listings are fetched in parts."""
    starts = F.sequence(first, last, F.expr(f"INTERVAL {days} DAYS"))
    return F.transform(starts, lambda d: F.struct(d.alias("after"), F.date_add(d, days).alias("before")))
