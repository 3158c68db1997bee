"""Rings of points as drawings, and what lies inside them, by higher-order functions over arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.format import Projection
from ..sources.tables import fitting, written


def svg_path(polygons: Column, to: Projection) -> Column:
    """The path text of polygons (arrays of rings of [lon, lat]): M and L for each ring, closed by Z; rings without points are left out."""

    def point(c: Column) -> Column:
        x, y = to.xy(F.get(c, 1), F.get(c, 0))
        return F.format_string("%.2f,%.2f", x, y)

    rings = F.filter(F.flatten(polygons), lambda r: F.size(r) > 0)
    return F.array_join(F.transform(rings, lambda r: F.concat(F.lit("M"), F.array_join(F.transform(r, point), "L"), F.lit("Z"))), " ")


def boxes(geometries: DataFrame) -> DataFrame:
    """Polygons of geometries (`polygons`) one a row, the largest box first: rank, polygon, lon0, lat0, lon1, lat1."""
    one = geometries.select(F.explode("polygons").alias("polygon"))
    at = lambda i: F.transform(F.flatten("polygon"), lambda c: F.get(c, i))
    one = one.select("polygon", F.array_min(at(0)).alias("lon0"), F.array_min(at(1)).alias("lat0"), F.array_max(at(0)).alias("lon1"), F.array_max(at(1)).alias("lat1"))
    area = (F.col("lon1") - F.col("lon0")) * (F.col("lat1") - F.col("lat0"))
    return one.orderBy(area.desc(), "lon0", "lat0")


def inside(rings: Column, lon: Column, lat: Column) -> Column:
    """Whether a point lies in a polygon: a ray to the east crosses its rings, holes too, an odd number of times.

    An edge counts where one end lies above the point's latitude and the other does not, so a corner is met once.
    """
    def crossings(ring: Column) -> Column:
        def edge(c: Column, i: Column) -> Column:
            d = F.get(ring, F.when(i == 0, F.size(ring) - 1).otherwise(i - 1))
            x0, y0, x1, y1 = F.get(c, 0), F.get(c, 1), F.get(d, 0), F.get(d, 1)
            cross = x0 + (lat - y0) / (y1 - y0) * (x1 - x0)
            return F.when((y0 > lat) != (y1 > lat), (lon < cross).cast("int")).otherwise(0)

        return F.aggregate(F.transform(ring, edge), F.lit(0), lambda a, b: a + b)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda a, b: a + b) % 2 == 1


#: Edges of a shape, and places, that meet in one task.
EDGES, PLACES = 50_000, 20_000


def _edges(shapes: DataFrame) -> DataFrame:
    """The edges of each shape (shape_, rings) in blocks of EDGES that lie side by side: from each point to the one before it, from the first to the last."""

    def ring(r: Column) -> Column:
        def edge(c: Column, i: Column) -> Column:
            d = F.get(r, F.when(i == 0, F.size(r) - 1).otherwise(i - 1))
            return F.struct(*[x.cast("double").alias(n) for n, x in (("x0", F.get(c, 0)), ("y0", F.get(c, 1)), ("x1", F.get(d, 0)), ("y1", F.get(d, 1)))])

        return F.transform(r, edge)

    e = shapes.select("shape_", F.posexplode("rings").alias("ring_", "r_")).select("shape_", "ring_", F.posexplode(ring(F.col("r_"))).alias("i_", "e_"))
    return e.select("shape_", "ring_", F.floor(F.col("i_") / EDGES).alias("block_"), "e_.*").filter("y0 <> y1 AND x0 IS NOT NULL AND x1 IS NOT NULL")


def _crossed(edges: pa.Table, places: pa.Table) -> pa.Table:
    """How many of the edges each place's ray to the east crosses, latitude by latitude."""
    x0, y0, x1, y1 = (edges[c].to_numpy() for c in ("x0", "y0", "x1", "y1"))
    lon, lat = places["lon_"].to_numpy(), places["lat_"].to_numpy()
    n, order = np.zeros(len(lat), np.int64), np.argsort(lat, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(lat[order])) + 1) if len(lat) else []:
        y = lat[own[0]]
        met = np.flatnonzero((y0 > y) != (y1 > y))
        cross = np.sort(x0[met] + (y - y0[met]) / (y1[met] - y0[met]) * (x1[met] - x0[met]))
        n[own] = len(cross) - np.searchsorted(cross, lon[own], side="right")
    held = n > 0
    shape = pa.array([edges["shape_"][0].as_py()] * int(held.sum()) if len(edges) else [], pa.string())
    return pa.table({"shape_": shape, "lon_": lon[held], "lat_": lat[held], "n_": n[held]})


def within(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """points (lon, lat and more) with the `name` of each shape (name, rings) they lie in, by the rule of `inside`.

    Places are told apart once, however many points lie at them. Blocks of a shape's edges meet ranges of places by latitude, in tasks
    of bounded size, and a place's crossings are summed over the blocks. Each latitude's crossings are sorted and its places found
    among them, so the work grows with the edges times the latitudes they span, not with points times edges. Edges and points with a
    missing coordinate count for nothing.
    """
    ground = points.select(F.col("lon").cast("double").alias("lon_"), F.col("lat").cast("double").alias("lat_")).filter("lon_ IS NOT NULL AND lat_ IS NOT NULL AND NOT isnan(lon_) AND NOT isnan(lat_)").distinct()
    ground = written(ground, "places")
    parts = max(1, -(-ground.count() // PLACES))
    # Numbers of partitions hold only for one run of a plan, so they are written.
    ground = written(ground.repartitionByRange(parts, "lat_", "lon_").withColumn("range_", F.spark_partition_id()), "places")
    ranges = ground.groupBy("range_").agg(F.min("lat_").alias("low_"), F.max("lat_").alias("high_"))
    # Rows that are equal in name and rings are one shape, given as often as they occur.
    many = shapes.withColumn("shape_", F.sha2(F.to_json(F.struct("name", "rings")), 256)).groupBy("shape_").agg(F.any_value("name").alias("name"), F.any_value("rings").alias("rings"), F.count(F.lit(1)).alias("times_"))
    many = written(many, "shapes")
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    here = ["shape_", "ring_", "block_", "range_"]
    edges = _edges(many.select("shape_", "rings")).join(fitting(ranges), (low <= F.col("high_")) & (high > F.col("low_")))
    spans = edges.groupBy(*here).agg(F.min(low).alias("from_"), F.max(high).alias("to_"))
    near = ground.join(spans, "range_").filter("lat_ >= from_ AND lat_ < to_").select(*here, "lon_", "lat_")
    near = near.toDF(*near.columns)  # columns of its own, as both sides come from the edges
    met = edges.select(*here, "x0", "y0", "x1", "y1").groupBy(*here).cogroup(near.groupBy(*here)).applyInArrow(_crossed, "shape_ string, lon_ double, lat_ double, n_ long")
    found = met.groupBy("shape_", "lon_", "lat_").agg(F.sum("n_").alias("n_")).filter("n_ % 2 = 1")
    named = found.join(many.select("shape_", "name", F.explode(F.expr("array_repeat(1, cast(times_ AS int))")).alias("one_")), "shape_").select("lon_", "lat_", "name")
    return points.join(named, (F.col("lon").cast("double") == F.col("lon_")) & (F.col("lat").cast("double") == F.col("lat_"))).select(*[points[c] for c in points.columns], "name")
