"""Announced winners: their outlets, their places on the map, and their links to draws."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.parse import fingerprint
from ..sources.tables import fitting
from .gazetteer import match_place

# Abbreviations of addresses and what they stand for, in order.
EXPANSIONS = [
    (r"\bE\.?\s?M\.?\s?R\.?\b", "EASTERN MAIN ROAD"),
    (r"\bS\.?\s?M\.?\s?R\.?\b", "SOUTHERN MAIN ROAD"),
    (r"\bW\.?\s?M\.?\s?R\.?\b", "WESTERN MAIN ROAD"),
    (r"\bP\.?\s?O\.?\s?S\.?\b", "PORT OF SPAIN"),
    (r"\bST\.\s", "ST "),
    (r"\bMT\.\s", "MT "),
    (r"\bS/GRANDE\b", "SANGRE GRANDE"),
    (r"\bSAN F'DO\b", "SAN FERNANDO"),
]
# Words that mark a line as an address.
STREET = r"(?i)\b(street|st\.?|road|rd\.?|avenue|ave\.?|highway|h'?way|drive|boulevard|blvd|lane|trace|junction|corner|cnr|plaza|mall|branch|shops?|lp\b|e\.?m\.?r\.?|s\.?m\.?r\.?|main rd|main road|circular|extension|village|court|terrace)\b"
NUMBERED = r"(?i)^\s*(#|no\.?\s*\d|lp\s*#?\s*\d|\d)"


def is_address(line: Column) -> Column:
    return line.rlike(NUMBERED) | line.rlike(STREET)


def _bare(c: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_locations(c: Column | str) -> Column:
    """The outlets that a location text names, as an array of (seq, outlet, address, area).

    Lines and semicolons part entries. Each line is marked as an address or not: an address right behind a line that is
    none belongs to it, and every other line is an outlet. What stands behind the last comma of the
    address, or of an outlet without one, is the area, unless that looks like an address itself.
    """
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    clean = F.transform(F.split(text, "[;\n]"), lambda x: _bare(F.trim(F.trim(_bare(x), F.lit('"')), F.lit(","))))
    marked = F.transform(F.filter(clean, lambda x: x != ""), lambda x: F.struct(x.alias("line"), is_address(x).alias("address")))
    pairs = F.transform(marked, lambda x, i: F.struct(x.alias("own"), F.get(marked, i - 1).alias("above"), F.get(marked, i + 1).alias("below")))
    named = F.filter(pairs, lambda p: ~(p["own"]["address"] & F.coalesce(~p["above"]["address"], F.lit(False))))

    def outlet(p: Column, i: Column) -> Column:
        line = p["own"]["line"]
        address = F.when(F.coalesce(p["below"]["address"], F.lit(False)) & ~p["own"]["address"], p["below"]["line"])
        said = F.coalesce(address, line)
        tail = F.when(said.contains(","), F.substring_index(said, ",", -1))
        own = address.isNull() & tail.isNotNull() & ~is_address(tail)  # the outlet's own line ends in its area
        head = F.regexp_replace(line, ",[^,]*$", "")
        area = F.when(own | address.isNotNull(), _bare(tail))
        return F.struct((i + 1).cast("int").alias("seq"), F.when(own, _bare(head)).otherwise(line).alias("outlet"), address.alias("address"), area.alias("area"))

    return F.transform(named, outlet)


@F.pandas_udf(StringType())
def unaccented(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, in capitals; Spark has no such function."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).upper())


def normal_place(c: Column) -> Column:
    """A text as places are looked up in it: capitals and digits, abbreviations written out."""
    t = unaccented(F.coalesce(c, F.lit("")))
    for pattern, full in EXPANSIONS:
        t = F.regexp_replace(t, pattern, full)
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" AND ")), r"[^A-Z0-9' ]+", " "), r"\s+", " "))


def announcements(cards: DataFrame) -> DataFrame:
    """Adds the fingerprint of seven fields by which an announcement is known again; one row for each of these."""
    numbers = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("numbers", F.array()), lambda x: x.cast("string")), ", "), F.lit("]"))
    key = fingerprint(*[F.col(c) for c in ("game", "draw_number", "draw_date_raw", "draw_time", "amount_cents", "location_raw")], numbers)
    c = cards.withColumn("fingerprint", key)
    return c.dropDuplicates(["fingerprint"])


def locations(winners: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """winner_id, seq, outlet, address, area of each outlet; with `places` (name, lat, lon) also place, lat, lon and geo_method.

    Area, address and outlet are searched in this order; longer names first.
    """
    x = winners.select(F.col("id").alias("winner_id"), F.explode(split_locations("location_raw")).alias("o")).select("winner_id", "o.*")
    if places is None:
        return x
    for c in ("area", "address", "outlet"):
        x = x.withColumn(f"{c}_n", normal_place(F.col(c)))
    # Of names that are spoken alike the first by name stands.
    known = places.select(normal_place(F.col("name")).alias("key"), F.struct("name", "lat", "lon").alias("p")).groupBy("key").agg(F.min("p").alias("p"))
    x = match_place(x, known.select(F.col("key").alias("name"), F.lit(0).alias("at")), "area_n", "address_n", "outlet_n").drop("area_n", "address_n", "outlet_n")
    x = x.join(fitting(known), F.col("place") == F.col("key"), "left").withColumns({"place": F.col("p.name"), "lat": F.col("p.lat"), "lon": F.col("p.lon")}).drop("key", "p")
    return x.withColumn("geo_method", F.when(F.col("place").isNull(), "unmatched").otherwise("gazetteer"))


def link(winners: DataFrame, draws: DataFrame, priority: Sequence[str]) -> DataFrame:
    """winners with draw_number, draw_date and match_method filled from the draws.

    A printed draw number gives the date of that draw (of the best source that has
    one). Without a number, a draw of the same numbers in any order is taken: one of
    the same date first, else the first by number. Draws are cut to one row for each
    numbers and date before they meet the winners, so no pairs of a group are made.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("source")), F.lit(0))
    rank = F.struct(F.when(rank > 0, rank).otherwise(len(priority) + 1), "source")
    d = draws.filter("draw_number IS NOT NULL").withColumn("rank_", rank).withColumn("set_", F.array_sort("numbers"))
    dates = d.filter("draw_date IS NOT NULL").groupBy(F.col("game").alias("g1"), F.col("draw_number").alias("n1")).agg(F.min_by("draw_date", "rank_").alias("found_date"))
    any_ = d.filter(F.size("set_") > 0).groupBy(F.col("game").alias("g2"), F.col("set_").alias("s2")).agg(F.min("draw_number").alias("any_number"))
    same = d.filter(F.size("set_") > 0).groupBy(F.col("game").alias("g3"), F.col("set_").alias("s3"), F.col("draw_date").alias("d3")).agg(F.min("draw_number").alias("same_number"))
    w = winners.withColumn("set_", F.array_sort(F.coalesce("numbers", F.array().cast("array<int>"))))
    w = w.join(dates, (F.col("game") == F.col("g1")) & (F.col("draw_number") == F.col("n1")), "left")
    w = w.join(any_, F.col("draw_number").isNull() & (F.col("game") == F.col("g2")) & (F.col("set_") == F.col("s2")), "left")
    w = w.join(same, F.col("draw_number").isNull() & (F.col("game") == F.col("g3")) & (F.col("set_") == F.col("s3")) & (F.col("draw_date") == F.col("d3")), "left")
    by_number = F.col("draw_number").isNotNull() & F.col("draw_date").isNull() & F.col("found_date").isNotNull()
    method = F.when(by_number, "draw_number").when(F.col("same_number").isNotNull(), "numbers+date").when(F.col("any_number").isNotNull(), "numbers")
    return w.withColumn("match_method", method).withColumn("draw_date", F.coalesce("draw_date", "found_date")).withColumn("draw_number", F.coalesce("draw_number", "same_number", "any_number")).select(*[c for c in winners.columns if c != "match_method"], "match_method")


def one_draw_each(winners: DataFrame, draws: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Winners with the date (d_date) and numbers (d_numbers) of their draw in the best source; those without a draw are left out."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("source")), F.lit(0))
    rank = F.struct(F.when(rank > 0, rank).otherwise(len(priority) + 1), "source")
    best = draws.filter("draw_number IS NOT NULL").groupBy(F.col("game").alias("d_game"), F.col("draw_number").alias("d_number"))
    best = best.agg(F.min_by(F.struct("draw_date", "numbers"), rank).alias("d")).select("d_game", "d_number", F.col("d.draw_date").alias("d_date"), F.col("d.numbers").alias("d_numbers"))
    return winners.join(best, (F.col("game") == F.col("d_game")) & (F.col("draw_number") == F.col("d_number"))).drop("d_game", "d_number")


def consistency(linked: DataFrame) -> DataFrame:
    """checked, dates, numbers: announcements with a draw, and those whose printed date (in either order) or numbers differ from it."""
    p = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    part = lambda i: F.regexp_extract("draw_date_raw", p, i).try_cast("int")
    day = lambda m, d: F.format_string("%04d-%02d-%02d", part(3), m, d)
    shown = F.col("draw_date_raw").rlike(p) & F.col("d_date").isNotNull()
    date = F.col("d_date").cast("string")
    moved = shown & (date != day(part(1), part(2))) & (date != day(part(2), part(1)))
    a, b = F.array_sort(F.coalesce("numbers", F.array().cast("array<int>"))), F.array_sort(F.coalesce("d_numbers", F.array().cast("array<int>")))
    return linked.agg(F.count(F.lit(1)).alias("checked"), F.count_if(moved).alias("dates"), F.count_if((F.size(a) > 0) & (F.size(b) > 0) & (a != b)).alias("numbers"))


def winner_vs_draw(winners: DataFrame, draws: DataFrame, priority: Sequence[str]) -> DataFrame:
    """The result row of `consistency`."""
    from .results import rows

    g = consistency(one_draw_each(winners, draws, priority)).filter("checked > 0").withColumn("game", F.lit("all"))
    detail = F.format_string("%d announcements have a draw; %d print another date, %d other numbers", "checked", "dates", "numbers")
    return rows(g, "winner_vs_draw_consistency", "linked announcements", F.col("checked"), F.col("dates"), None, F.col("dates") / F.col("checked"), detail)


def location_rows(winners: DataFrame, locations: DataFrame) -> DataFrame:
    """game, outlet, area of each named outlet; winners without one are left out."""
    return winners.select(F.col("id").alias("winner_id"), "game").join(locations, "winner_id").select("game", "outlet", "area")


def tops(rows: DataFrame, column: str, top: int = 3) -> DataFrame:
    """game, how often the most frequent value occurs, how many there are, and the top ones."""
    c = rows.filter(F.col(column) != "").groupBy("game", column).agg(F.count(F.lit(1)).alias("c"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("game").orderBy(F.col("c").desc(), column)))
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", F.col(column).alias("v"), "c")))), lambda x: F.format_string("%s x%d", x["v"], x["c"]))
    return r.groupBy("game").agg(F.max("c").alias(f"{column}_most"), F.count(F.lit(1)).alias(f"{column}s"), F.array_join(said, ", ").alias(f"{column}_top"))


def location_concentration(winners: DataFrame, locations: DataFrame, least: int = 5) -> DataFrame:
    """Result rows of where a game's winners bought: outlets and areas."""
    from .results import rows

    x = location_rows(winners, locations)
    g = x.groupBy("game").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).join(tops(x, "outlet"), "game", "left").join(tops(x, "area"), "game", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    detail = F.format_string("%d named outlets, %d different, %d areas; outlets: %s; areas: %s", "n", none("outlets"), none("areas"), F.coalesce("outlet_top", F.lit("n/a")), F.coalesce("area_top", F.lit("n/a")))
    return rows(g, "winner_location_concentration", "announced winners", F.col("n"), none("outlet_most"), None, none("outlets"), detail)


def nested(winners: DataFrame, locations: DataFrame) -> DataFrame:
    """Winners with their outlets as an array in order; those without one have an empty array."""
    o = F.struct("seq", "outlet", "address", "area", "place", "lat", "lon")
    per = locations.filter("outlet <> ''").groupBy(F.col("winner_id").alias("id")).agg(F.array_sort(F.collect_list(o)).alias("outlets"))
    return winners.join(per, "id", "left").withColumn("outlets", F.coalesce("outlets", F.array().cast(per.schema["outlets"].dataType)))


def place_markers(winners: DataFrame, locations: DataFrame) -> DataFrame:
    """One row per mapped place: label, lat, lon, count, amount_cents, outlets, and winners by game."""
    x = winners.select(F.col("id").alias("winner_id"), "game", "amount_cents", "draw_date").join(locations.filter("outlet <> '' AND lat IS NOT NULL"), "winner_id")
    games = x.groupBy("place", "game").agg(F.count(F.lit(1)).alias("c"))
    games = games.groupBy("place").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("game", "c")))).alias("games"))
    # The last winner in the order of a page: dates from the newest, those without one at the end, then ids downwards.
    last = F.struct(F.coalesce(F.col("draw_date").cast("string"), F.lit("")), "winner_id", -F.col("seq"))
    p = x.groupBy("place").agg(
        F.min_by("lat", last).alias("lat"), F.min_by("lon", last).alias("lon"), F.count(F.lit(1)).alias("count"),
        F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("amount_cents"), F.sort_array(F.collect_set("outlet")).alias("outlets"),
    )
    return p.join(games, "place").withColumn("label", F.initcap(F.lower("place")))


def filtered(nested_winners: DataFrame, place: str | None = None, game: str | None = None, text: str | None = None) -> DataFrame:
    """Winners of a place and a game, whose outlets, numbers or amount hold the text; what is not given does not count."""
    x = nested_winners
    if place:
        x = x.filter(F.exists("outlets", lambda o: o["place"] == place))
    if game:
        x = x.filter(F.col("game") == game)
    if text:
        said = F.lower(F.concat_ws(" ", F.transform("outlets", lambda o: F.concat_ws(" ", o["outlet"], o["address"], o["area"])), F.col("numbers").cast("string"), (F.col("amount_cents") / 100).cast("string")))
        x = x.filter(F.contains(said, F.lit(text.lower())))
    return x
