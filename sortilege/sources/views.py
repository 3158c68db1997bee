"""Draw tables over the star-schema tables, with the columns that every operator reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import sequence


def single_draws(spark: SparkSession, d: str) -> DataFrame:
    """One number per draw: games are event types, numbers 0..99."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        F.col("event_type").alias("game"), F.col("event_id").alias("draw_number"), F.to_date("ts").alias("draw_date"), F.weekday("ts").cast("int").alias("dow"), F.hour("ts").cast("int").alias("hour"),
        F.get_json_object("props", "$.k").cast("int").alias("number"), F.rint(F.col("value") * 100).cast("long").alias("jackpot_cents"), (F.col("user_id") % 10 == 0).cast("int").alias("wins"),
    )


def set_draws(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    """k different numbers of 1..7 per draw: games are order priorities."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    sets = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("numbers")).filter(F.size("numbers") == k)
    got = sets.join(o, sets.l_orderkey == o.o_orderkey)
    return got.select(F.col("o_orderpriority").alias("game"), F.col("o_orderkey").alias("draw_number"), F.to_date("o_orderdate").alias("draw_date"), "numbers", F.rint(F.col("o_totalprice") * 100).cast("long").alias("jackpot_cents"))


def two_sources(spark: SparkSession, d: str) -> DataFrame:
    """Source a holds all draws; b a third of them, with planted differences."""
    a = single_draws(spark, d).withColumn("source", F.lit("a"))
    b = a.filter(F.col("draw_number") % 3 == 0).withColumn("source", F.lit("b"))
    b = b.withColumn("number", F.when(F.col("draw_number") % 7 == 0, (F.col("number") + 1) % 100).otherwise(F.col("number")))
    b = b.withColumn("jackpot_cents", F.when(F.col("draw_number") % 11 == 0, F.rint(F.col("jackpot_cents") * 1.5).cast("long")).otherwise(F.col("jackpot_cents")))
    a = a.withColumn("jackpot_cents", F.when(F.col("draw_number") % 5 != 0, F.col("jackpot_cents")))
    return a.unionByName(b)


def era_draws(spark: SparkSession, d: str) -> DataFrame:
    """Numbers 1..20, but 1..25 in the middle third of each game."""
    a = sequence(single_draws(spark, d))
    middle = (F.col("nth") * 3 > F.col("n")) & (F.col("nth") * 3 <= F.col("n") * 2)
    return a.withColumn("number", F.when(middle, F.col("number") % 25 + 1).otherwise(F.col("number") % 20 + 1))


def lists(draws: DataFrame) -> DataFrame:
    """Adds `numbers`, the list of the one number."""
    return draws.withColumn("numbers", F.array("number"))


def two_lists(spark: SparkSession, d: str) -> DataFrame:
    """Both sources with lists of numbers, times, and rows of zeros where source a has no result."""
    x = lists(two_sources(spark, d)).withColumn("draw_time", F.when(F.col("source") == "b", F.format_string("%02d:00", "hour")))
    return x.withColumn("numbers", F.when((F.col("source") == "a") & (F.col("draw_number") % 13 == 0), F.array(F.lit(0))).otherwise(F.col("numbers")))


ARCHIVE = ["game", "draw_number", "draw_date", "draw_period", "numbers", "bonus_number", "jackpot_cents", "wins", "source"]


def archive(spark: SparkSession, d: str) -> DataFrame:
    """All draws of all games and sources: single numbers, sets, four digits, and histories whose pool changes."""
    one = lists(two_sources(spark, d)).withColumn("draw_period", F.when(F.col("hour") < 12, "Morning").otherwise("Evening")).withColumn("bonus_number", (F.col("hour") % 6).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    some = set_draws(spark, d).withColumns({"draw_period": none("string"), "bonus_number": none("int"), "wins": none("int"), "source": F.lit("a")})
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate")
    digits = F.transform(F.array(*[F.floor(F.col("o_orderkey") / 10**i) % 10 for i in (3, 2, 1, 0)]), lambda x: x.cast("int"))
    quads = o.select(F.lit("pick4").alias("game"), F.col("o_orderkey").alias("draw_number"), F.to_date("o_orderdate").alias("draw_date"), digits.alias("numbers"))
    quads = quads.withColumns({"draw_period": none("string"), "bonus_number": none("int"), "jackpot_cents": none("long"), "wins": none("int"), "source": F.lit("a")})
    eras = lists(era_draws(spark, d)).withColumns({"game": F.concat(F.lit("era_"), "game"), "draw_period": none("string"), "bonus_number": none("int"), "source": F.lit("a")})
    out = one.select(ARCHIVE)
    for x in (some, quads, eras):
        out = out.unionByName(x.select(ARCHIVE))
    return out


def games(spark: SparkSession, d: str) -> DataFrame:
    """What is declared of each game."""
    kinds = [r[0] for r in spark.read.parquet(f"{d}/events.parquet").select("event_type").distinct().orderBy("event_type").collect()]
    sets = [r[0] for r in spark.read.parquet(f"{d}/orders.parquet").select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    rows = [(k, 0, 99, "hour", 0, 9, False, True) for k in kinds] + [(k, 1, 7, None, None, None, False, False) for k in sets]
    rows += [("pick4", 0, 9, None, None, None, True, False)] + [(f"era_{k}", 1, 20, None, None, None, False, False) for k in kinds]
    return spark.createDataFrame(rows, "code string, pool_min int, pool_max int, bonus_name string, bonus_pool_min int, bonus_pool_max int, ordered boolean, has_jackpot boolean")


def winners(spark: SparkSession, d: str) -> DataFrame:
    """An announcement for each won draw: every third prints its draw number, the others a date, which in a fourth of all is another one."""
    e = single_draws(spark, d).filter("wins > 0")
    n, day = F.col("draw_number"), F.col("draw_date")
    date = F.when(n % 4 == 0, F.date_add(day, 400)).otherwise(day)
    place = F.element_at(F.array(*map(F.lit, PLACES)), (n % len(PLACES) + 1).cast("int"))
    name = F.concat(F.lit("Shop "), (n % 40).cast("string"))
    text = F.when(n % 11 == 0, F.lit(None).cast("string")).when(n % 5 == 0, F.concat(name, F.lit(", "), place, F.lit("; Kiosk "), (n % 7).cast("string"), F.lit(", North"))).otherwise(F.concat(name, F.lit(", "), place))
    return e.select(
        n.alias("id"), "game", F.when(n % 3 == 0, n).alias("draw_number"), F.when(n % 3 != 0, date).alias("draw_date"), F.date_format(date, "dd/MM/yyyy").alias("draw_date_raw"), F.lit(None).cast("string").alias("draw_time"),
        F.lit(None).cast("int").alias("players"), F.col("jackpot_cents").alias("amount_cents"), F.when(n % 9 != 0, F.array("number")).otherwise(F.array((F.col("number") + 1) % 100)).alias("numbers"), text.alias("location_raw"),
    )


PLACES = ["Port", "Old Port", "Bay", "Hill Bay"]


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, 10.0 + i / 8, -61.0 - i / 4) for i, p in enumerate(PLACES)], "name string, lat double, lon double")


def ingest_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of ingests: one entry for each event, every seventh failed."""
    e = spark.read.parquet(f"{d}/events.parquet")
    month = F.element_at(F.array(*map(F.lit, ["Jan", "Feb", "Mar", "Apr", "May", "Jun"])), (F.col("event_id") % 6 + 1).cast("int"))
    target = F.concat("event_type", F.lit(":"), (F.lit(2020) + F.col("event_id") % 5).cast("string"), F.lit("-"), month)
    bad = F.col("event_id") % 7 == 0
    return e.select(F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("source"), target.alias("target"), F.when(bad, "error").otherwise("ok").alias("status"), F.col("event_id").alias("rows"), F.when(bad, F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("note"), F.col("ts").alias("ts"))
