"""Routes, zones and the range join against values worked out by hand or by loops."""

import math

import pytest
from pyspark.sql import functions as F

from wayrisk.operators.joins import events_near, near_pairs, route_zones, zone_hits
from wayrisk.operators.routes import base_routes, lane_routes, points_of, routes
from wayrisk.sources.dimensions import hub_rows, zone_rows, zones


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.fixture(scope="module")
def mumbai(spark):
    r = spark.createDataFrame([(1, 19.076, 72.8777, 25.2048, 55.2708)], "route_id int, olat double, olon double, dlat double, dlon double")
    return routes(r).persist()


def test_tables():
    assert len(zone_rows()) == 29 and len(hub_rows()) == 26


def test_mumbai_dubai(mumbai):
    got = {r.mode: (r.km, len(r.points)) for r in mumbai.collect()}
    assert got == {"air": (1935.1, 19), "road": (4917.5, 31), "sea": (2515.6, 19)}


def test_intersections(spark, mumbai):
    got = {(r.mode, r.zone, r.min_distance_km, r.closest_idx) for r in route_zones(points_of(mumbai), zones(spark)).collect()}
    assert got == {("road", "Afghanistan", 291.2, 12), ("road", "Iran Sanctions Zone", 508.7, 18), ("sea", "Hormuz Tanker Disruption Area", 206.8, 17), ("sea", "Strait of Hormuz", 246.3, 16)}


@pytest.mark.parametrize(
    ("lat", "lon", "want"),
    [
        (26.5, 56.0, [("Strait of Hormuz", 0.0), ("Hormuz Tanker Disruption Area", 37.2)]),
        (14.0, 43.0, [("Red Sea / Bab el-Mandeb", 77.5), ("Bab el-Mandeb Shipping Advisory Area", 137.3), ("Red Sea Drone Corridor", 247.0)]),
        (48.5, 36.0, [("Ukraine War Zone", 0.0), ("Ukraine Airspace Closure", 0.0)]),
        (1.3, 103.8, [("Strait of Malacca", 338.6)]),
        (51.5, -0.1, []),
    ],
)
def test_zone_points(spark, lat, lon, want):
    got = spark.range(1).select(zone_hits(F.lit(lat), F.lit(lon)).alias("z")).first().z
    assert [(z.zone, z.d1) for z in got] == want


def test_coinciding_ends_and_short_routes(spark):
    rows = [(1, 0.0, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 1.0), (3, 10.0, 10.0, 10.0, 10.0), (4, 90.0, 0.0, 90.0, 0.0), (5, 41.01, 28.97, 41.01, 28.97), (6, None, 1.0, 2.0, 3.0)]
    r = spark.createDataFrame(rows, "route_id int, olat double, olon double, dlat double, dlon double")
    got = {x.route_id: x for x in base_routes(r).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and len(got[1].points) == 2 and got[1].km == 0 and len(got[2].points) == 10 and got[2].km == 111.2
    for k, lat, lon, *_ in (x for x in rows if x[0] in (1, 3, 5)):
        assert got[k].km == 0 and all(abs(p.lat - lat) < 1e-5 and abs(p.lon - lon) < 1e-5 for p in got[k].points)
    modes = {(x.route_id, x.mode): x for x in routes(r).collect()}
    assert len(modes) == 15 and modes[1, "air"].km == 0 and modes[5, "road"].km == 0 and all(not math.isnan(p.lat) for x in modes.values() for p in x.points)


def test_near_pairs_at_poles_and_date_line(spark):
    places = [(0, 89.9, 10.0), (1, 89.9, -170.0), (2, 0.0, 179.9), (3, 0.0, -179.9), (4, 45.2, 7.01), (5, 45.0, 6.99), (6, -60.0, 0.01), (7, -60.3, -0.4)]
    df = spark.createDataFrame(places, "id int, lat double, lon double")
    got = {(r.id, r.event_id) for r in near_pairs(df, df.withColumnRenamed("id", "event_id"), 50.0).collect()}
    assert got == {(i, j) for i, a, b in places for j, c, d in places if km(a, b, c, d) <= 50}


def test_events_near_caps(spark):
    r = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 20.0)], "route_id int, olat double, olon double, dlat double, dlon double")
    events = spark.range(4000).select(F.col("id").cast("string").alias("event_id"), ((F.col("id") % 7) / 20.0).alias("lat"), (F.col("id") % 200 / 10.0).alias("lon"), F.lit(0.9).alias("label_confidence"), F.lit("2").alias("schema_version"))
    got = events_near(routes(r, ["air"]), events).collect()
    per = {}
    for x in got:
        per[x.wp] = per.get(x.wp, 0) + 1
    n = 20
    assert got and max(per.values()) <= 200 // (n - 1) and len(got) <= 200 + 200 // (n - 1)


def test_lanes(spark):
    df = spark.createDataFrame([(1, i, 0.0, i / 10.0) for i in range(101)], "route_id int, idx int, lat double, lon double")
    got = lane_routes(df).first()
    assert len(got.points) == 20 and got.points[-1].lon == 10.0 and got.km == 1111.9
