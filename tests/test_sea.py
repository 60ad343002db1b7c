"""Sea routes against Dijkstra over the same lanes."""

import heapq
import math
import random

from pyspark.sql import functions as F

from wayrisk.operators.sea import lane_edges, sea_routes, shortest
from wayrisk.plans import analysis, domain

DATA = "/root/testdata/sf0.001"
ASKED = "route_id int, olat double, olon double, dlat double, dlon double"
LANES = "lane_id int, idx int, lat double, lon double"


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def dijkstra(edges, start):
    best, queue = {}, [(0.0, start)]
    while queue:
        d, x = heapq.heappop(queue)
        if x not in best:
            best[x] = d
            for y, w in edges.get(x, []):
                heapq.heappush(queue, (d + w, y))
    return best


def test_random_network(spark):
    rng = random.Random(4)
    place = {k: (rng.uniform(-60, 60), rng.uniform(-175, 175)) for k in range(40)}
    lanes, edges = [], {}
    for lane in range(75):
        a, b = rng.sample(range(34 if lane else 40), 2)
        middle = [(rng.uniform(-60, 60), rng.uniform(-175, 175)) for _ in range(rng.randint(0, 3))]
        line = [place[a], *middle, place[b]]
        lanes += [(lane, i, *p) for i, p in enumerate(line)]
        w = sum(km(*p, *q) for p, q in zip(line, line[1:], strict=False))
        edges.setdefault(a, []).append((b, w))
        edges.setdefault(b, []).append((a, w))
    lanes += [(900, 0, 1.0, 1.0), (901, 0, None, 2.0), (901, 1, 3.0, None)]
    asked, want = [], {}
    for i in range(60):
        a, b = rng.randrange(40), rng.randrange(40)
        asked.append((i, place[a][0] + 0.1, place[a][1], place[b][0], place[b][1] + 0.1))
        found = dijkstra(edges, a) if a in edges else {}
        if a != b and b in found:
            want[i] = round(km(*asked[-1][1:3], *place[a]) + found[b] + km(*asked[-1][3:], *place[b]), 1)
    asked += [(100, None, 1.0, 2.0, 3.0), (101, 89.0, 0.0, *place[0])]
    got = {r.route_id: r for r in sea_routes(spark.createDataFrame(asked, ASKED), spark.createDataFrame(lanes, LANES)).collect()}
    assert set(got) == set(want) and len(want) >= 25 and all(abs(got[i].km - want[i]) <= 0.1 for i in want)
    for i, r in got.items():
        first, last = r.points[0], r.points[-1]
        assert len(r.points) <= 20 and (first.lat, first.lon, last.lat, last.lon) == asked[i][1:]


def test_long_chain_and_ties(spark):
    """A detour that is shorter, a path of many lanes, two paths of one length, and junctions on either side of the date line."""
    rows = [(k, i, 0.0, float(k + i)) for k in range(12) for i in (0, 1)]
    rows += [(50, 0, 0.0, 0.0), (50, 1, 40.0, 6.0), (50, 2, 0.0, 12.0)]
    rows += [(60, 0, 0.0, 12.0), (60, 1, 0.0, 180.0), (61, 0, 0.0, -180.0), (61, 1, 10.0, -170.0)]
    edges = lane_edges(spark.createDataFrame(rows, LANES))
    asked = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 12.0), (1, 0.0, 0.0, 10.0, -170.0), (2, 0.0, 5.0, 0.0, 5.1)], ASKED)
    got = {r.route_id: r for r in sea_routes(asked, spark.createDataFrame(rows, LANES)).collect()}
    assert set(got) == {0, 1} and abs(got[0].km - km(0, 0, 0, 12)) < 0.1 and len(got[0].points) == 15
    assert abs(got[1].km - km(0, 0, 0, 180) - km(0, 180, 10, -170)) < 0.2
    a, b = (edges.where(f"lane = '{x}'").select(F.min("a")).first()[0] for x in (0, 11))
    both = shortest(spark.createDataFrame([(a, a), (a, b)], "s long, t long"), edges).collect()
    assert {len(r.lanes) for r in both} == {0, 11}


def test_modes_over_lanes(spark):
    """Sea routes follow lanes where these join both ends; others keep the arc."""
    requests, events = domain.requests(spark, DATA), domain.events(spark, DATA)
    plain = {(r.route_id, r.mode): r.route_km for r in analysis.multi_mode(requests, events, domain.now()).collect()}
    lane = {(r.route_id, r.mode): r.route_km for r in analysis.multi_mode(requests, events, domain.now(), lanes=domain.lanes(spark, DATA)).collect()}
    way = {r.route_id: r.km for r in sea_routes(requests, domain.lanes(spark, DATA)).collect()}
    assert len(way) == 21 and plain.keys() == lane.keys()
    assert all(lane[k] == (way[k[0]] if k[1] == "sea" and k[0] in way else plain[k]) for k in lane)
