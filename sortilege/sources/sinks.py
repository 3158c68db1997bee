"""Where results go: tables that are merged, appended to or seeded, the ingest log, and what is left to fetch.

A merge reads the present table and writes the next version beside it; readers
follow the newest version that was finished, so a job that fails halfway changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.core import upsert

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


class Versions:
    """A table at path as numbered folders, of which the greatest with a finished write is the present one."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def last(self) -> int:
        """The newest finished version; 0 where there is none."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS"))
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=0)

    def read(self) -> DataFrame:
        n = self.last()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={n}") if n else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/version={self.last() + 1}")
        return self.read()


DRAWS = "game string, draw_number long, source string, draw_date date, draw_time string, draw_period string, dow int, numbers array<int>, bonus_number int, multiplier string, jackpot_cents long, wins int, promo string, source_url string, raw string, fetched_at timestamp"
JACKPOTS = "game string, draw_number long, kind string, jackpot_cents long, source string, fetched_at timestamp"
WINNERS = "fingerprint string, game string, draw_number long, draw_date date, draw_date_raw string, draw_time string, players int, amount_cents long, numbers array<int>, location_raw string, source string, source_url string, fetched_at timestamp"
INFERRED = "game string, draw_number long, draw_date date, prev_jackpot long, this_jackpot long, next_jackpot long, method string, verdict string, confidence double, published_wins int, agrees_with_published int"
LOG = "source string, target string, status string, rows long, note string, ts timestamp"


def stamped(rows: DataFrame, now: Column) -> DataFrame:
    return rows.withColumn("fetched_at", now)


def merge_draws(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per game, number and source: of every figure the newest that is not null, and the time of the first sight.

    Rows without a number never meet others.
    """
    columns = old.columns
    both = upsert(old.withColumn("seen_", F.col("fetched_at")), new.select(columns).withColumn("seen_", F.col("fetched_at")), ["game", "draw_number", "source"], "fetched_at")
    first = old.unionByName(new.select(columns)).filter("draw_number IS NOT NULL").groupBy("game", "draw_number", "source").agg(F.min("fetched_at").alias("first_"))
    keyed = both.join(first, ["game", "draw_number", "source"], "left").withColumn("fetched_at", F.coalesce("first_", "fetched_at"))
    return keyed.select(columns)


def merge_last(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str = "fetched_at") -> DataFrame:
    """The newest row of each key, whole."""
    both = old.unionByName(new.select(old.columns))
    rest = F.struct(*[c for c in old.columns if c not in keys])
    return both.groupBy(*keys).agg(F.max_by(rest, order).alias("r_")).select(*keys, "r_.*").select(old.columns)


def merge_winners(old: DataFrame, new: DataFrame) -> DataFrame:
    """By fingerprint: numbers, date and players of the newest sight, the newest draw number that is not null, all else as first seen."""
    both = old.unionByName(new.select(old.columns))
    newest = ("numbers", "draw_date", "players")
    first = [c for c in old.columns if c not in (*newest, "fingerprint", "draw_number", "fetched_at")]
    g = both.groupBy("fingerprint").agg(
        *[F.max_by(c, "fetched_at").alias(c) for c in newest], F.max_by("draw_number", F.when(F.col("draw_number").isNotNull(), F.col("fetched_at"))).alias("draw_number"),
        *[F.min_by(c, "fetched_at").alias(c) for c in first], F.min("fetched_at").alias("fetched_at"),
    )
    return g.select(old.columns)


def replace_games(old: DataFrame, new: DataFrame) -> DataFrame:
    """Inferred wins are made anew for whole games: rows of games that new has none of stay."""
    return old.join(F.broadcast(new.select("game").distinct()), "game", "left_anti").unionByName(new.select(old.columns))


def seeded(old: DataFrame, seed: DataFrame, key: str = "code") -> DataFrame:
    """Adds the seed rows whose key is not there yet."""
    return old.unionByName(seed.join(old.select(key), key, "left_anti").select(old.columns))


def append(rows: DataFrame, path: str) -> None:
    """Adds findings or log rows; what is there stays."""
    rows.write.mode("append").parquet(path)


def log_row(spark: SparkSession, source: str, target: str, status: str, rows: int, note: str | None = None) -> DataFrame:
    return spark.createDataFrame([(source, target, status, rows, note)], "source string, target string, status string, rows long, note string").withColumn("ts", F.current_timestamp())


def months_to_fetch(games: DataFrame, log: DataFrame, source: str, today: Column) -> DataFrame:
    """game, year, month, target (game:YYYY-Mon) of the months from a game's first year on that are to be fetched.

    Months logged as ok are done, but for the present and the last one; months to come are left out.
    """
    start = F.make_date("first_year", F.lit(1), F.lit(1))
    m = games.select("game", F.explode(F.sequence(start, F.trunc(today, "month"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.month("m"))
    m = m.withColumn("target", F.concat("game", F.lit(":"), F.year("m").cast("string"), F.lit("-"), name))
    done = log.filter((F.col("source") == source) & (F.col("status") == "ok")).select("target", F.lit(True).alias("done")).distinct()
    hot = F.col("m") >= F.add_months(F.trunc(today, "month"), -1)
    left = m.join(done, "target", "left").filter(F.col("done").isNull() | hot)
    return left.select("game", F.year("m").alias("year"), F.month("m").alias("month"), "target")
