"""How figures are shown, and where places lie on a drawn map."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(cents: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(cents / 100, 2)), F.lit("-"))


def compact_money(cents: Column) -> Column:
    v = cents / 100
    whole = lambda x: F.format_number(F.rint(x), 0)
    return F.when(v.isNull(), "-").when(v >= 1e6, F.concat(F.lit("$"), F.format_string("%.2f", v / 1e6), F.lit("M"))).when(v >= 1e3, F.concat(F.lit("$"), F.replace(whole(v / 1e3), F.lit(",")), F.lit("k"))).otherwise(F.concat(F.lit("$"), whole(v)))


def p_value(p: Column, digits: int = 1, missing: str = "-") -> Column:
    """Four places, or powers of ten under 1e-4: one digit after the point on pages, two in reports."""
    return F.when(p.isNull() | F.isnan(p), missing).when(p < 1e-4, F.format_string(f"%.{digits}e", p)).otherwise(F.format_string("%.4f", p))


def verdict(p: Column, q: Column) -> Column:
    return F.when(q < 0.05, "flagged").when(p < 0.05, "p under .05").when(p.isNotNull(), "consistent").otherwise("descriptive")


@dataclass(frozen=True)
class Projection:
    """Equirectangular projection of a box of degrees, with a margin, into the middle of a box of the drawing."""

    lon0: float
    lat0: float
    lon1: float
    lat1: float
    x: float
    y: float
    width: float
    height: float
    margin: float = 0.02

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        a, b = (self.lon1 - self.lon0) * self.margin, (self.lat1 - self.lat0) * self.margin
        return self.lon0 - a, self.lat0 - b, self.lon1 + a, self.lat1 + b

    def contains(self, lat: Column, lon: Column) -> Column:
        lon0, lat0, lon1, lat1 = self.bounds
        return lon.between(lon0, lon1) & lat.between(lat0, lat1)

    def xy(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        lon0, lat0, lon1, lat1 = self.bounds
        k = math.cos(math.radians((lat0 + lat1) / 2))
        scale = min(self.width / ((lon1 - lon0) * k), self.height / (lat1 - lat0))
        left, top = self.x + (self.width - (lon1 - lon0) * k * scale) / 2, self.y + (self.height - (lat1 - lat0) * scale) / 2
        return (lon - lon0) * (k * scale) + left, (F.lit(lat1) - lat) * scale + top


def ranked_islands(polygons: list) -> list:
    """Polygons of a GeoJSON geometry, the largest bounding box first."""
    def area(p):
        xs, ys = [c[0] for r in p for c in r], [c[1] for r in p for c in r]
        return (max(xs) - min(xs)) * (max(ys) - min(ys))

    return sorted(polygons, key=lambda p: -area(p))


def box(polygon: list) -> tuple[float, float, float, float]:
    xs, ys = [c[0] for r in polygon for c in r], [c[1] for r in polygon for c in r]
    return min(xs), min(ys), max(xs), max(ys)


def placed(markers, main: Projection, inset: Projection | None = None, border: float = 11.0):
    """Markers (lat, lon, count) with x, y and radius r, to one place; those in neither box go to the inset if they lie north of `border`."""
    lat, lon = F.col("lat"), F.col("lon")
    at = main.xy(lat, lon)
    if inset is not None:
        there = inset.contains(lat, lon) | (~main.contains(lat, lon) & (lat > border))
        at = tuple(F.when(there, b).otherwise(a) for a, b in zip(at, inset.xy(lat, lon)))
    most = markers.agg(F.max("count")).first()[0] or 1
    even = lambda v: F.rint(v * 10) / 10
    return markers.withColumns({"x": even(at[0]), "y": even(at[1]), "r": even(4.5 + 11 * F.pow(F.col("count") / most, 0.6))})

