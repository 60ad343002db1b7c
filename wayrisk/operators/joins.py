"""Spatial joins between routes, events and zones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.functions.geo import haversine_km
from wayrisk.operators.routes import points_of, sampled
from wayrisk.sources.dimensions import EARTH_KM, zone_rows

ROUTE = ["route_id", "mode"]
RESULTS = 200
_HITS = "array<struct<d1:double,zone_ord:int,zone:string,base_risk:double,category:string>>"


def zone_hits(lat: Column, lon: Column, mode: Column | None = None) -> Column:
    """array<struct<d1, zone_ord, zone, base_risk, category>> of the zones that hold a point, nearest first.

    The zones are a fixed array in the expression, so no join or shuffle is needed; points without a zone get an empty array.
    """
    fixed = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("zone"), F.lit(a).alias("lat"), F.lit(o).alias("lon"), F.lit(r).alias("radius"), F.lit(c).alias("category"), F.lit(b).alias("risk"), F.array(*map(F.lit, m)).alias("modes")) for i, n, a, o, r, c, b, m, _ in zone_rows()))
    # a degree of latitude is over 110 km, so most zones are out without a distance
    close = F.filter(fixed, lambda z: F.abs(lat - z["lat"]) * 110 <= z["radius"])
    if mode is not None:
        close = F.filter(close, lambda z: F.array_contains(z["modes"], mode))
    measured = F.transform(close, lambda z: F.struct(haversine_km(lat, lon, z["lat"], z["lon"]).alias("d"), z.alias("z")))
    inside = F.filter(measured, lambda x: x["d"] <= x["z"]["radius"])
    hits = F.transform(inside, lambda x: F.struct(F.round(x["d"], 1).alias("d1"), x["z"]["ord"].alias("zone_ord"), x["z"]["zone"].alias("zone"), x["z"]["risk"].alias("base_risk"), x["z"]["category"].alias("category")))
    return F.coalesce(F.array_sort(hits), F.array().cast(_HITS))


def event_zones(events: DataFrame) -> DataFrame:
    """``events`` with the names of the zones that hold them, nearest first."""
    return events.withColumn("zones", F.transform(zone_hits(F.col("lat"), F.col("lon")), lambda z: z["zone"]))


def route_zones(points: DataFrame, zones: DataFrame) -> DataFrame:
    """(route_id, mode, zone, ...) of the zones that a route enters, at its first point inside.

    The zones are a fixed table and broadcast; only rows within a radius leave the join.
    """
    z = F.broadcast(zones)
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("zlat"), F.col("zlon"))
    inside = points.join(z, F.array_contains("applies_to", F.col("mode")) & (d <= F.col("radius_km"))).withColumn("d", d)
    first = F.min_by(F.struct("d", "idx"), "idx").alias("f")
    hit = inside.groupBy(*ROUTE, "zone_ord", "zone", "category", "base_risk").agg(first)
    return hit.select(*ROUTE, "zone_ord", "zone", "category", "base_risk", F.round("f.d", 1).alias("min_distance_km"), F.col("f.idx").alias("closest_idx"))


def _cells(lat: Column, lon: Column, radius_km: float) -> Column:
    """One-degree cells that a circle can touch, as numbers; whole bands of longitude near a pole."""
    r = radius_km / EARTH_KM
    dlat = math.degrees(r)
    band = F.sequence(F.floor(lat - dlat).cast("int"), F.floor(lat + dlat).cast("int"))
    polar = F.abs(lat) + dlat >= 89.9
    dlon = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(r)) / F.cos(F.radians(F.least(F.abs(lat), F.lit(89.0)))))))
    wide = F.sequence(F.lit(0), F.lit(359))
    near = F.sequence(F.floor(lon - dlon).cast("int"), F.floor(lon + dlon).cast("int"))
    columns = F.when(polar, wide).otherwise(near)
    return F.array_distinct(F.flatten(F.transform(band, lambda b: F.transform(columns, lambda c: b * 360 + F.pmod(c, F.lit(360))))))


def near_pairs(waypoints: DataFrame, events: DataFrame, radius_km: float) -> DataFrame:
    """Rows of ``waypoints`` and ``events`` within a radius, with their distance ``km``: an equi-join on cells, then the distance."""
    w = waypoints.withColumn("cell", F.explode(_cells(F.col("lat"), F.col("lon"), radius_km)))
    e = events.withColumn("cell", (F.floor("lat") * 360 + F.pmod(F.floor("lon"), F.lit(360))).cast("int"))
    e = e.withColumnsRenamed({"lat": "elat", "lon": "elon"})
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon"))
    return w.join(e, "cell").withColumn("km", km).where(F.col("km") <= radius_km).drop("cell")


def events_near(routes: DataFrame, events: DataFrame, radius_km: float = 50.0, results: int = RESULTS, min_confidence: float = 0.5) -> DataFrame:
    """(route_id, mode, event_id, wp, distance_km) of the events near each route.

    Of each sampled waypoint, in order, the ``results // waypoints`` nearest (all, if that is 0); an event counts at its
    first waypoint; no waypoint is asked once ``results`` events are there. Distances are to the nearest point of the whole route.
    Only slim columns are ranked; join the events back on event_id.
    """
    wp = points_of(sampled(routes)).withColumnRenamed("idx", "wp")
    wp = wp.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*ROUTE)))
    slim = events.where((F.col("label_confidence") >= min_confidence) & (F.col("schema_version") >= "2")).select("event_id", "lat", "lon")
    near = near_pairs(wp, slim, radius_km)
    rank = F.row_number().over(Window.partitionBy(*ROUTE, "wp").orderBy("km", "event_id"))
    quota = F.floor(F.lit(results) / F.col("n"))
    # at most ``results`` of a waypoint can count, unless the quota is 0: the constant lets Spark limit each window group
    near = near.withColumn("rank", rank).where((quota == 0) | (F.col("rank") <= quota))
    first = near.groupBy(*ROUTE, "event_id").agg(F.min_by(F.struct("wp", "elat", "elon"), "wp").alias("f"))
    first = first.select(*ROUTE, "event_id", "f.wp", "f.elat", "f.elon")
    per = first.groupBy(*ROUTE, "wp").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*ROUTE).orderBy("wp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = per.withColumn("before", before).where(F.col("before") < results).select(*ROUTE, "wp")
    kept = first.join(open_, [*ROUTE, "wp"])
    to_route = F.array_min(F.transform("points", lambda p: haversine_km(p["lat"], p["lon"], F.col("elat"), F.col("elon"))))
    out = kept.join(routes.select(*ROUTE, "points"), ROUTE)
    return out.select(*ROUTE, "event_id", "wp", F.round(to_route, 3).alias("distance_km"))


def route_distance(events: DataFrame, points: Column) -> DataFrame:
    """``events`` with the distance to the nearest vertex of a route."""
    return events.withColumn("distance_km", F.array_min(F.transform(points, lambda p: haversine_km(p["lat"], p["lon"], F.col("lat"), F.col("lon")))))
