"""Sea routes: shortest paths over a network of lanes, from all requests' ends at once.

A lane is a polyline; lanes meet at their ends, its junctions, so that rounds count junctions and not points. Ends of
requests snap to the nearest junction within reach. Distances spread from all distinct origins together:
each round relaxes only what the last one improved, pruned by the farthest destination that its origin still asks for,
so requests that share an origin share the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.functions.geo import haversine_km, path_km
from wayrisk.operators.cut import cut
from wayrisk.operators.joins import _cells
from wayrisk.operators.routes import ENDS, evenly_sampled

#: A request's end farther than that from every junction has no way to the sea.
REACH_KM = 300.0


def junction(lat: Column, lon: Column) -> Column:
    """A number for a place, by 4 digits; both sides of the date line are one."""
    part = lambda x: F.round(x * 10_000).cast("long")
    return (part(lat) + 900_000) * 3_600_000 + F.pmod(part(lon) + 1_800_000, F.lit(3_600_000))


def lane_edges(lanes: DataFrame) -> DataFrame:
    """(a, b, lane, km, points): the lanes (lane_id, idx, lat, lon), both ways; of lanes between the same junctions the shortest, the first on a tie.

    Points without a place are left out, and lanes of one point or that end where they began.
    """
    point = F.struct("idx", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    whole = lanes.dropna(subset=["lane_id", "lat", "lon"]).groupBy("lane_id").agg(F.array_sort(F.collect_list(point)).alias("p"))
    whole = whole.select(F.col("lane_id").cast("string").alias("lane"), F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points"))
    end = lambda k: junction(F.element_at("points", k)["lat"], F.element_at("points", k)["lon"])
    there = whole.where(F.size("points") > 1).select(end(1).alias("a"), end(-1).alias("b"), "lane", path_km(F.col("points")).alias("km"), "points")
    back = there.select(F.col("b").alias("a"), F.col("a").alias("b"), "lane", "km", F.reverse("points").alias("points"))
    best = there.unionByName(back).where("a <> b").groupBy("a", "b").agg(F.min(F.struct("km", "lane", "points")).alias("e"))
    return best.select("a", "b", "e.lane", "e.km", "e.points")


def _snapped(ends: DataFrame, edges: DataFrame, reach_km: float) -> DataFrame:
    """(lat, lon, node) of the distinct places ``ends`` (lat, lon) that have a junction within reach: the nearest."""
    first = F.element_at("points", 1)
    nodes = edges.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(first["lat"].alias("lat"), first["lon"].alias("lon"))).alias("p"))
    nodes = nodes.select("node", F.col("p.lat").alias("nlat"), F.col("p.lon").alias("nlon"))
    nodes = nodes.withColumn("cell", (F.floor("nlat") * 360 + F.pmod(F.floor("nlon"), F.lit(360))).cast("int"))
    near = ends.distinct().withColumn("cell", F.explode(_cells(F.col("lat"), F.col("lon"), reach_km))).join(nodes, "cell")
    near = near.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))).where(F.col("km") <= reach_km)
    return near.groupBy("lat", "lon").agg(F.min(F.struct("km", "node")).alias("s")).select("lat", "lon", "s.node")


def shortest(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, t, km, lanes) of each pair of junctions ``asked`` (s, t) that lanes join: the shortest path's length and its lanes in order.

    Of paths of one length, the one with fewer lanes, then the one whose lanes come first.
    """
    slim = cut(edges.select("a", "b", "lane", F.col("km").alias("w")))
    none = F.array().cast("array<string>")
    best = cut(asked.select("s").distinct().select("s", F.col("s").alias("node"), F.lit(0.0).alias("km"), F.lit(0).alias("hops"), none.alias("lanes")))
    live = best
    while not live.isEmpty():
        step = live.join(slim, live["node"] == slim["a"]).select("s", F.col("b").alias("node"), F.struct((F.col("km") + F.col("w")).alias("km"), (F.col("hops") + 1).alias("hops"), F.array_append("lanes", F.col("lane")).alias("lanes")).alias("new"))
        step = step.groupBy("s", "node").agg(F.min("new").alias("new"))
        # how far each origin still has to look: as far as its farthest destination, without end while one isn't reached
        reached = asked.join(best.select("s", F.col("node").alias("t"), "km"), ["s", "t"], "left")
        far = reached.groupBy("s").agg(F.max(F.coalesce("km", F.lit(float("inf")))).alias("far"))
        old = F.struct("km", "hops", "lanes")
        better = step.join(far, "s").where(F.col("new.km") <= F.col("far")).join(best, ["s", "node"], "left").where(F.col("km").isNull() | (F.col("new") < old))
        live = cut(better.select("s", "node", "new.*"))
        best = cut(best.unionByName(live).groupBy("s", "node").agg(F.min(old).alias("m")).select("s", "node", "m.*"))
    return asked.join(best.withColumnRenamed("node", "t"), ["s", "t"]).select("s", "t", "km", "lanes")


def sea_routes(requests: DataFrame, lanes: DataFrame, reach_km: float = REACH_KM) -> DataFrame:
    """(route_id, points, km) of the requests (route_id, olat, olon, dlat, dlon) that lanes join; points are 20 at most, evenly sampled.

    The way leads from the origin to its junction, along lanes, and to the destination; ``km`` is the whole way's length. Requests
    with an unknown end, without a junction in reach, with one junction for both ends, or without a path are left out.
    """
    edges = cut(lane_edges(lanes))
    r = requests.select("route_id", *(F.col(c).cast("double") for c in ENDS)).dropna(subset=ENDS)
    ends = r.select(F.explode(F.array(*(F.struct(F.col(f"{x}lat").alias("lat"), F.col(f"{x}lon").alias("lon")) for x in "od"))).alias("e")).select("e.*")
    nodes = cut(_snapped(ends, edges, reach_km))
    at = lambda x, name: nodes.select(F.col("lat").alias(f"{x}lat"), F.col("lon").alias(f"{x}lon"), F.col("node").alias(name))
    snapped = cut(r.join(at("o", "s"), ["olat", "olon"]).join(at("d", "t"), ["dlat", "dlon"]).where("s <> t"))
    paths = shortest(cut(snapped.select("s", "t").distinct()), edges)
    # the points of a path: its lanes' in order, each from its junction on, which the lane before ended with
    node = paths.select("s", "t", F.posexplode("lanes").alias("i", "lane"))
    line = node.join(edges.select("lane", "a", "b", "points"), "lane")
    line = line.groupBy("s", "t", "i").agg(F.collect_list(F.struct("a", "b", "points")).alias("ways"))
    ordered = line.groupBy("s", "t").agg(F.array_sort(F.collect_list(F.struct("i", "ways"))).alias("legs"))
    start = F.struct(F.col("s").alias("at"), F.array().cast("array<struct<lat:double,lon:double>>").alias("points"))

    def follow(acc: Column, leg: Column) -> Column:
        way = F.element_at(F.filter(leg["ways"], lambda w: w["a"] == acc["at"]), 1)
        own = F.when(F.size(acc["points"]) == 0, way["points"]).otherwise(F.slice(way["points"], 2, F.size(way["points"]) - 1))
        return F.struct(way["b"].alias("at"), F.concat(acc["points"], own).alias("points"))

    ways = ordered.select("s", "t", F.aggregate("legs", start, follow, lambda a: a["points"]).alias("way"))
    place = lambda x: F.array(F.struct(F.col(f"{x}lat").alias("lat"), F.col(f"{x}lon").alias("lon")))
    whole = snapped.join(ways, ["s", "t"]).select("route_id", F.concat(place("o"), "way", place("d")).alias("whole"))
    return whole.select("route_id", evenly_sampled(F.col("whole")).alias("points"), F.round(path_km(F.col("whole")), 1).alias("km"))


def over_lanes(found: DataFrame, sea: DataFrame) -> DataFrame:
    """The routes ``found`` (route_id, mode, points, km), those by sea along lanes where ``sea`` has them."""
    lane = sea.select("route_id", F.lit("sea").alias("mode"), F.col("points").alias("way"), F.col("km").alias("way_km"))
    return found.join(lane, ["route_id", "mode"], "left").select("route_id", "mode", F.coalesce("way", "points").alias("points"), F.coalesce("way_km", "km").alias("km"))
