"""Routes as DataFrames: (route_id, mode, idx, lat, lon) points and (route_id, mode, km) totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.functions.geo import downsample, haversine_km, path_km, steps_between
from wayrisk.sources.dimensions import MODES, hub_rows

#: Columns of a request; a route with an unknown end is left out.
ENDS = ["olat", "olon", "dlat", "dlon"]


def nearest_hub(lat: Column, lon: Column) -> Column:
    """struct<d, ord, lat, lon> of the nearest of the transit hubs, the first on a tie.

    The hubs are a fixed array in the expression, so no join is needed.
    """
    hubs = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(a).alias("lat"), F.lit(o).alias("lon")) for i, _, a, o, _ in hub_rows()))
    return F.array_min(F.transform(hubs, lambda h: F.struct(haversine_km(lat, lon, h["lat"], h["lon"]).alias("d"), h["ord"].alias("ord"), h["lat"].alias("lat"), h["lon"].alias("lon"))))


def _arcs(legs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, points: the points of legs (keys, leg, a, b, c, d, n) of arcs, joined in the order of ``leg``.

    Each leg becomes rows, one per point, so that what all its points share is computed once.
    """
    p1, l1, p2, l2 = (F.radians(c) for c in "abcd")
    dot = F.cos(p1) * F.cos(l1) * F.cos(p2) * F.cos(l2) + F.cos(p1) * F.sin(l1) * F.cos(p2) * F.sin(l2) + F.sin(p1) * F.sin(p2)
    legs = legs.withColumn("o", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    each = legs.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("o") < 1e-10, 1).otherwise(F.col("n") - 1))).alias("i"))
    # ends that coincide have no arc to divide by; their two points are the ends themselves
    o, apart = F.col("o"), F.col("o") >= 1e-10
    t = F.when(F.col("n") > 1, F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(0.0)
    sine = F.when(apart, F.sin(o)).otherwise(1.0)
    each = each.withColumns({"wa": F.sin((1 - t) * o) / sine, "wb": F.sin(t * o) / sine})
    xyz = lambda p, l: (F.cos(p) * F.cos(l), F.cos(p) * F.sin(l), F.sin(p))  # noqa: E731, E741
    x, y, z = (F.col("wa") * u + F.col("wb") * v for u, v in zip(xyz(p1, l1), xyz(p2, l2), strict=True))
    end = lambda first, last: F.when(F.col("i") == 0, F.col(first)).otherwise(F.col(last))
    lat = F.when(~apart, end("a", "c")).otherwise(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))))
    lon = F.when(~apart, end("b", "d")).otherwise(F.degrees(F.atan2(y, x)))
    point = F.struct("leg", "i", lat.alias("lat"), lon.alias("lon"))
    joined = each.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("p"))
    return joined.select(*keys, F.transform("p", lambda q: F.struct(q["lat"].alias("lat"), q["lon"].alias("lon"))).alias("points"))


def routes(requests: DataFrame, modes: list[str] = MODES) -> DataFrame:
    """(route_id, mode, points, km) of each request (route_id, olat, olon, dlat, dlon) and mode.

    Air and sea follow the arc, sea at 1.3 times its length; road goes over the nearest hubs of both ends, whose
    leg is left out if they are within 200 km.
    """
    r = requests.select("route_id", *(F.col(c).cast("double") for c in ENDS)).dropna(subset=ENDS)
    ends = r.select("*", nearest_hub(F.col("olat"), F.col("olon")).alias("ho"), nearest_hub(F.col("dlat"), F.col("dlon")).alias("hd"))
    leg = lambda mode, k, a, b, c, d: F.struct(F.lit(mode).alias("mode"), F.lit(k).alias("leg"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"), F.col(d).alias("d"))
    legs = [leg(m, 0, "olat", "olon", "dlat", "dlon") for m in modes if m != "road"]
    if "road" in modes:
        legs += [leg("road", 1, "olat", "olon", "ho.lat", "ho.lon"), leg("road", 2, "ho.lat", "ho.lon", "hd.lat", "hd.lon"), leg("road", 3, "hd.lat", "hd.lon", "dlat", "dlon")]
    legs = ends.select("route_id", F.explode(F.array(*legs)).alias("x")).select("route_id", "x.*")
    legs = legs.withColumn("leg_km", haversine_km(*(F.col(c) for c in "abcd"))).where((F.col("leg") != 2) | (F.col("leg_km") > 200))
    n = F.when(F.col("mode") == "road", steps_between(F.col("leg_km"), 5, 20, 150)).otherwise(steps_between(F.col("leg_km"), 15, 50, 100))
    points = _arcs(legs.withColumn("n", n), ["route_id", "mode"])
    direct = requests.select("route_id", haversine_km(*(F.col(c).cast("double") for c in ENDS)).alias("arc"))
    out = points.join(direct, "route_id")
    km = F.when(F.col("mode") == "air", F.round("arc", 1)).when(F.col("mode") == "sea", F.round(F.col("arc") * 1.3, 1)).otherwise(F.round(path_km(F.col("points")), 1))
    return out.select("route_id", "mode", "points", km.alias("km"))


def base_routes(requests: DataFrame) -> DataFrame:
    """(route_id, points, km) of the single arc with 10 to 50 points."""
    r = requests.select("route_id", F.lit(0).alias("leg"), *(F.col(c).cast("double").alias(x) for c, x in zip(ENDS, "abcd", strict=True))).dropna(subset=list("abcd"))
    r = r.withColumn("km", haversine_km(*(F.col(c) for c in "abcd"))).withColumn("n", steps_between(F.col("km"), 10, 50, 100))
    return _arcs(r, ["route_id", "km"]).select("route_id", "points", F.round("km", 1).alias("km"))


def evenly_sampled(points: Column, n: int = 20) -> Column:
    """``n`` points at even steps of index, the last one included (W8); shorter paths stay."""
    step = (F.size(points) - 1) / F.lit(float(n - 1))
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(points, (F.bround(i * step) + 1).cast("int")))
    return F.when(F.size(points) <= n, points).otherwise(picked)


def lane_routes(lanes: DataFrame) -> DataFrame:
    """(route_id, points, km) of sea lanes given as rows (route_id, idx, lat, lon), down to 20 points."""
    ordered = lanes.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon"))).alias("p"))
    full = F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    return ordered.select("route_id", evenly_sampled(full).alias("points"), F.round(path_km(full), 1).alias("km"))


def points_of(routes_: DataFrame, column: str = "points", keys: tuple[str, ...] = ("route_id", "mode")) -> DataFrame:
    """One row per point: keys, idx, lat, lon."""
    return routes_.select(*keys, F.posexplode(column).alias("idx", "p")).select(*keys, "idx", "p.lat", "p.lon")


def sampled(routes_: DataFrame, spacing_km: float = 100.0) -> DataFrame:
    """The routes with ``points`` downsampled."""
    return routes_.withColumn("points", downsample(F.col("points"), spacing_km))
