"""Places named in texts, found by joining the texts' word groups with the names.

A name is met where its own words stand in a row, so every text is cut into groups of as many
words as some name has, which join the names by their words. What the words leave open,
signs between them and borders, is then looked at for the few names that met. The work grows with
the texts, and not with the number of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import fitting

WORD = "[A-Z0-9]+"


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def names_of(places: DataFrame, name: str = "name", order: str | None = None) -> DataFrame:
    """(name, rank, key, size): each name in capitals once, ranked by length, longer ones first, then by `order` and the alphabet."""
    x = places.select(F.upper(name).alias("name"), (F.col(order) if order else F.lit(0)).alias("at")).filter(F.trim("name") != "")
    x = x.groupBy("name").agg(F.min("at").alias("at")).withColumn("w", _words(F.col("name")))
    # A name without letters A-Z or digits is met by its first sign.
    key = F.when(F.size("w") > 0, F.array_join("w", " ")).otherwise(F.substring("name", 1, 1))
    return x.select("name", F.struct((-F.length("name")).alias("l"), "at", "name").alias("rank"), key.alias("key"), F.size("w").alias("size"))


def match_place(rows: DataFrame, places: list[str] | DataFrame, *fields: str) -> DataFrame:
    """Adds `place`: the first place named as a whole word in the first field that names any; longer names go first, then in the given order.

    places: names, or rows (name, at). Case does not matter; a name's borders are letters A-Z and digits. Equal texts are looked at once.
    """
    spark = rows.sparkSession
    if not isinstance(places, DataFrame):
        places = spark.createDataFrame(list(enumerate(places)), "at long, name string")
    names = fitting(names_of(places, order="at"))
    sizes = sorted(r[0] for r in names.select("size").distinct().collect())  # numbers of words of a name
    texts = rows.select(*[F.col(f).alias(f"t{i}_") for i, f in enumerate(fields)]).distinct()
    cols = [f"t{i}_" for i in range(len(fields))]
    one = texts.select(*cols, F.posexplode(F.array(*[F.upper(c) for c in cols])).alias("field", "u")).filter("u IS NOT NULL").withColumn("w", _words(F.col("u")))

    def groups(k: int) -> Column:
        if k == 0:
            return F.split("u", "")
        starts = F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("w", i, k), " "))

    if not sizes:
        return rows.withColumn("place", F.lit(None).cast("string"))
    keys = F.explode(F.array_distinct(F.flatten(F.array(*[groups(k) for k in sizes]))))
    met = one.select(*cols, "field", "u", keys.alias("key")).join(names, "key")
    quoted = F.replace("name", F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    named = F.regexp_like("u", F.concat(F.lit("(?<![A-Z0-9])\\Q"), quoted, F.lit("\\E(?![A-Z0-9])")))
    best = met.filter(named).groupBy(*cols).agg(F.min(F.struct("field", "rank")).alias("hit_"))
    same = F.lit(True)
    for f, c in zip(fields, cols):
        same = same & F.col(f).eqNullSafe(F.col(c))
    return rows.join(best, same, "left").withColumn("place", F.col("hit_.rank.name")).select(*rows.columns, "place")
