"""Column expressions on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayrisk.sources.dimensions import EARTH_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def steps_between(km: Column, least: int, most: int, every: int) -> Column:
    """Points of an arc: one per ``every`` km, within bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(km / every))).cast("int")


def path_km(points: Column) -> Column:
    """Sum of the distances between neighbours of an array of points."""
    legs = F.transform(
        F.sequence(F.lit(1), F.size(points) - 1),
        lambda i: haversine_km(F.element_at(points, i)["lat"], F.element_at(points, i)["lon"], F.element_at(points, i + 1)["lat"], F.element_at(points, i + 1)["lon"]),
    )
    return F.when(F.size(points) > 1, F.aggregate(legs, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def downsample(points: Column, spacing_km: float = 100.0) -> Column:
    """Points at least ``spacing_km`` of path apart, with both ends; two or fewer stay as they are."""
    first = F.element_at(points, 1)
    start = F.struct(F.array(first).alias("kept"), F.lit(0.0).alias("gone"), first.alias("last"))

    def step(acc: Column, p: Column) -> Column:
        gone = acc["gone"] + haversine_km(acc["last"]["lat"], acc["last"]["lon"], p["lat"], p["lon"])
        far = gone >= spacing_km
        return F.struct(
            F.when(far, F.array_append(acc["kept"], p)).otherwise(acc["kept"]).alias("kept"),
            F.when(far, 0.0).otherwise(gone).alias("gone"),
            p.alias("last"),
        )

    kept = F.aggregate(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), start, step, lambda a: a["kept"])
    last, end = F.element_at(kept, -1), F.element_at(points, -1)
    return F.when(F.size(points) <= 2, points).when((last["lat"] == end["lat"]) & (last["lon"] == end["lon"]), kept).otherwise(F.array_append(kept, end))
