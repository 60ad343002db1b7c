"""DuckDB SQL for the queries, written on its own from the operators' definitions."""

from __future__ import annotations

import re

from wayrisk.plans import domain
from wayrisk.sources import dimensions as D


# The queries that a news source is asked in turn, stated apart from the engine's.
ROTATION = [
    "conflict war military", "sanctions embargo trade war", "terrorism attack bombing", "protest civil unrest",
    "natural disaster earthquake flood", "shipping maritime piracy", "airspace closure flight ban", "border dispute territorial",
]


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _case(table: dict[str, float], key: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


def _hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"(2 * {D.EARTH_KM} * atan2(sqrt({h}), sqrt(1 - {h})))"


_BAND = "CASE WHEN {0} < 0.25 THEN 'LOW' WHEN {0} < 0.5 THEN 'MEDIUM' WHEN {0} < 0.75 THEN 'HIGH' ELSE 'CRITICAL' END"
_NOW = f"TIMESTAMP '{domain.NOW}'"
_ZONES = "zones(zone_ord, zone, zlat, zlon, radius, category, base_risk, applies_to) AS (VALUES " + ", ".join(f"({i}, {_text(n)}, {float(a)}, {float(o)}, {float(r)}, '{c}', {float(b)}, {m})" for i, n, a, o, r, c, b, m, _ in D.zone_rows()) + ")"
_HUBS = "hubs(hub_ord, hlat, hlon) AS (VALUES " + ", ".join(f"({i}, {float(a)}, {float(o)})" for i, _, a, o, _ in D.hub_rows()) + ")"
_EV = f"""ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS ord, {domain.pick_sql(domain.TEXTS, 'event_id')} AS raw_text, {domain.pick_sql(domain.SOURCES, 'user_id')} AS source,
  {domain.pick_sql(domain.PUBLISHERS, 'user_id')} AS publisher, event_id % 3 = 0 AS has_publishers, 'https://www.site' || (event_id % 50) || '.example.org/' || event_id AS source_url,
  ((event_id * 7919) % 14000) / 100.0::DOUBLE - 70 AS lat, ((event_id * 104729) % 36000) / 100.0::DOUBLE - 180 AS lon, {domain.pick_sql(domain.LABELS, 'event_id')} AS label,
  0.30::DOUBLE + (event_id % 66) / 100.0::DOUBLE AS label_confidence, least(greatest(value / 200.0, 0.0::DOUBLE), 1.0::DOUBLE) AS intensity_score, ts AS published_at, 1 + event_id % 4 AS corroboration_count FROM events)"""
_HITS = f"hits AS (SELECT * FROM (SELECT ev.event_id, z.*, {_hav('ev.lat', 'ev.lon', 'z.zlat', 'z.zlon')} AS d FROM ev, zones z) WHERE d <= radius)"


def _weights(events: str) -> str:
    """CTEs f (weights) over a relation with distance_km."""
    age = f"greatest(epoch_us({_NOW}) - epoch_us(published_at), 0)"
    return f"""w AS (SELECT *, greatest(power(2.0, -{age} / 86400000000.0::DOUBLE), 0.01) AS r, CASE WHEN distance_km <= 0 THEN 1.0 ELSE 1 / (1 + power(distance_km / 50.0, 2)) END AS p FROM {events}),
f AS (SELECT *, round(r, 6) AS recency_weight, round(p, 6) AS proximity_weight, round(greatest(0.0, least(1.0, intensity_score * (0.5 + 0.3 * r + 0.2 * p))), 6) AS composite_risk FROM w)"""


_RISK = f"""a AS (SELECT *, least(composite_risk * ({_case(D.LABEL_MULTIPLIER, 'label', '0.5')})::DOUBLE, 1.0) AS adj FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY route_id, mode ORDER BY adj DESC, event_id) AS rn, count(*) OVER (PARTITION BY route_id, mode) AS n FROM a),
t AS (SELECT *, CASE WHEN n < 4 THEN 0 ELSE greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT)) END AS cut FROM k),
g AS (SELECT route_id, mode, max(adj) AS mx, avg(CASE WHEN rn > cut AND rn <= n - cut THEN adj END) AS mn, max(n) AS event_count, string_agg(CASE WHEN rn <= 5 THEN event_id END, ',' ORDER BY rn) AS top_events FROM t GROUP BY ALL),
lc AS (SELECT route_id, mode, label, count(*) AS c FROM k WHERE rn <= greatest(1, n // 2) GROUP BY ALL),
dom AS (SELECT route_id, mode, label AS dominant_label FROM (SELECT *, row_number() OVER (PARTITION BY route_id, mode ORDER BY c DESC, label) AS q FROM lc) WHERE q = 1),
fin AS (SELECT g.*, dom.dominant_label, least((0.60 * mx + 0.40 * mn) * CASE WHEN event_count < 3 THEN 0.85 ELSE 1.0 END, 1.0) AS final FROM g JOIN dom ON g.route_id = dom.route_id AND g.mode = dom.mode),
risk AS (SELECT route_id, mode, round(final, 6) AS event_risk, {_BAND.format('final')} AS event_band, event_count, round(mx, 6) AS max_score, round(mn, 6) AS mean_score, dominant_label, top_events FROM fin)"""
_GROUPS = f"{_EV}, s AS (SELECT *, ((ord * 31) % 4000) / 10.0::DOUBLE AS distance_km, ord % 20 AS route_id, {domain.pick_sql(['air', 'sea'], '(ord // 20)')} AS mode FROM ev), {_weights('s')}"

_REQ = """req0 AS (SELECT CAST(n_nationkey AS BIGINT) AS route_id, (CAST(n_nationkey AS BIGINT) + 7) % 25 AS dk FROM nation),
req AS (SELECT route_id, CAST((route_id * 37) % 120 - 50 AS DOUBLE) AS olat, CAST((route_id * 73) % 340 - 170 AS DOUBLE) AS olon, CAST((dk * 37) % 120 - 50 AS DOUBLE) AS dlat, CAST((dk * 73) % 340 - 170 AS DOUBLE) AS dlon FROM req0)"""
_NEAREST = "(SELECT {0} FROM (SELECT hlat, hlon, hub_ord, " + _hav("{1}", "{2}", "hlat", "hlon") + " AS d FROM hubs ORDER BY d, hub_ord LIMIT 1))"


def _routes(least: int = 15) -> str:
    """CTEs pts (points of all modes) and rt (km) of the requests."""
    return f"""{_HUBS}, {_REQ},
hd AS (SELECT r.*, h.hub_ord, h.hlat, h.hlon, {_hav('r.olat', 'r.olon', 'h.hlat', 'h.hlon')} AS od, {_hav('r.dlat', 'r.dlon', 'h.hlat', 'h.hlon')} AS dd FROM req r, hubs h),
hb AS (SELECT route_id, arg_min(hlat, (od, hub_ord)) AS h1lat, arg_min(hlon, (od, hub_ord)) AS h1lon, arg_min(hlat, (dd, hub_ord)) AS h2lat, arg_min(hlon, (dd, hub_ord)) AS h2lon FROM hd GROUP BY route_id),
q AS (SELECT req.*, hb.* EXCLUDE (route_id), {_hav('olat', 'olon', 'dlat', 'dlon')} AS arc FROM req JOIN hb USING (route_id)),
legs AS (
  SELECT route_id, m.mode, 0 AS leg, olat AS a, olon AS b, dlat AS c, dlon AS d, greatest({least}, least(50, CAST(floor(arc / 100) AS BIGINT))) AS n FROM q, (VALUES ('air'), ('sea')) m(mode)
  UNION ALL SELECT route_id, 'road', 1, olat, olon, h1lat, h1lon, greatest(5, least(20, CAST(floor({_hav('olat', 'olon', 'h1lat', 'h1lon')} / 150) AS BIGINT))) FROM q
  UNION ALL SELECT route_id, 'road', 2, h1lat, h1lon, h2lat, h2lon, greatest(5, least(20, CAST(floor({_hav('h1lat', 'h1lon', 'h2lat', 'h2lon')} / 150) AS BIGINT))) FROM q WHERE {_hav('h1lat', 'h1lon', 'h2lat', 'h2lon')} > 200
  UNION ALL SELECT route_id, 'road', 3, h2lat, h2lon, dlat, dlon, greatest(5, least(20, CAST(floor({_hav('h2lat', 'h2lon', 'dlat', 'dlon')} / 150) AS BIGINT))) FROM q),
om AS (SELECT *, acos(greatest(-1.0, least(1.0, cos(radians(a)) * cos(radians(b)) * cos(radians(c)) * cos(radians(d)) + cos(radians(a)) * sin(radians(b)) * cos(radians(c)) * sin(radians(d)) + sin(radians(a)) * sin(radians(c))))) AS o FROM legs),
i AS (SELECT *, unnest(range(0, CASE WHEN o < 1e-10 THEN 2 ELSE n END)) AS i FROM om),
ab AS (SELECT *, CASE WHEN o < 1e-10 THEN 0 ELSE sin((1 - i / (n - 1)::DOUBLE) * o) / sin(o) END AS wa, CASE WHEN o < 1e-10 THEN 0 ELSE sin(i / (n - 1)::DOUBLE * o) / sin(o) END AS wb FROM i),
v AS (SELECT *, wa * cos(radians(a)) * cos(radians(b)) + wb * cos(radians(c)) * cos(radians(d)) AS x, wa * cos(radians(a)) * sin(radians(b)) + wb * cos(radians(c)) * sin(radians(d)) AS y, wa * sin(radians(a)) + wb * sin(radians(c)) AS z FROM ab),
pts AS (SELECT route_id, mode, row_number() OVER (PARTITION BY route_id, mode ORDER BY leg, i) - 1 AS idx,
  CASE WHEN o >= 1e-10 THEN degrees(atan2(z, sqrt(x * x + y * y))) WHEN i = 0 THEN a ELSE c END AS lat, CASE WHEN o >= 1e-10 THEN degrees(atan2(y, x)) WHEN i = 0 THEN b ELSE d END AS lon FROM v),
lg AS (SELECT *, lag(lat) OVER (PARTITION BY route_id, mode ORDER BY idx) AS plat, lag(lon) OVER (PARTITION BY route_id, mode ORDER BY idx) AS plon, max(idx) OVER (PARTITION BY route_id, mode) AS top FROM pts),
sg AS (SELECT *, {_hav('plat', 'plon', 'lat', 'lon')} AS seg FROM lg),
pk AS (SELECT route_id, mode, count(*) AS n_points, sum(seg) AS path FROM sg GROUP BY ALL),
rt AS (SELECT pk.route_id, pk.mode, n_points, path, CASE pk.mode WHEN 'air' THEN round(arc, 1) WHEN 'sea' THEN round(arc * 1.3, 1) ELSE round(path, 1) END AS km FROM pk JOIN q USING (route_id))"""


_SAMPLED = """fold AS (SELECT route_id, mode, idx, lat, lon, top, 0.0::DOUBLE AS gone, true AS keep FROM sg WHERE idx = 0
  UNION ALL SELECT s.route_id, s.mode, s.idx, s.lat, s.lon, s.top, CASE WHEN fold.gone + s.seg >= 100 THEN 0.0 ELSE fold.gone + s.seg END, fold.gone + s.seg >= 100 FROM fold JOIN sg s ON s.route_id = fold.route_id AND s.mode = fold.mode AND s.idx = fold.idx + 1),
wp AS (SELECT route_id, mode, lat, lon, row_number() OVER (PARTITION BY route_id, mode ORDER BY idx) - 1 AS wp, count(*) OVER (PARTITION BY route_id, mode) AS n FROM fold WHERE keep OR idx = top)"""
_NEAR = f"""nr AS (SELECT * FROM (SELECT wp.route_id, wp.mode, wp.wp, wp.n, e.event_id, e.lat AS elat, e.lon AS elon, {_hav('wp.lat', 'wp.lon', 'e.lat', 'e.lon')} AS km
  FROM wp JOIN ev e ON e.lat BETWEEN wp.lat - 0.5 AND wp.lat + 0.5 WHERE e.label_confidence >= 0.5) WHERE km <= 50),
rk AS (SELECT *, row_number() OVER (PARTITION BY route_id, mode, wp ORDER BY km, event_id) AS r FROM nr),
fs AS (SELECT route_id, mode, event_id, min(wp) AS wp, any_value(elat) AS elat, any_value(elon) AS elon FROM rk WHERE 200 // n = 0 OR r <= 200 // n GROUP BY ALL),
fs2 AS (SELECT route_id, mode, event_id, min(wp) AS wp, any_value(elat) AS elat, any_value(elon) AS elon FROM fs GROUP BY route_id, mode, event_id),
pw AS (SELECT route_id, mode, wp, count(*) AS c FROM fs2 GROUP BY ALL),
op AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY route_id, mode ORDER BY wp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pw),
kp AS (SELECT fs2.* FROM fs2 JOIN op ON fs2.route_id = op.route_id AND fs2.mode = op.mode AND fs2.wp = op.wp WHERE before < 200),
near AS (SELECT kp.route_id, kp.mode, kp.event_id, any_value(kp.wp) AS wp, round(min({_hav('pts.lat', 'pts.lon', 'kp.elat', 'kp.elon')}), 3) AS distance_km FROM kp JOIN pts ON kp.route_id = pts.route_id AND kp.mode = pts.mode GROUP BY kp.route_id, kp.mode, kp.event_id)"""
_RZ = f"""{_ZONES}, zi AS (SELECT * FROM (SELECT p.route_id, p.mode, p.idx, z.zone, z.base_risk, z.radius, {_hav('p.lat', 'p.lon', 'z.zlat', 'z.zlon')} AS d FROM pts p, zones z WHERE list_contains(z.applies_to, p.mode)) WHERE d <= radius),
rz AS (SELECT route_id, mode, zone, any_value(base_risk) AS base_risk, round(arg_min(d, idx), 1) AS min_distance_km, min(idx) AS closest_idx FROM zi GROUP BY route_id, mode, zone),
zt AS (SELECT route_id, mode, round(least(max(base_risk) + least(0.20, (count(*) - 1) * 0.05), 0.95), 4) AS zone_risk, count(*) AS n_zones FROM rz GROUP BY ALL)"""


def _multi(zones: bool, seed: bool, modes: str = "'air', 'sea', 'road'") -> str:
    risk = "CASE WHEN er > 0 AND zr > 0 THEN er * 0.70 + zr * 0.30 WHEN er > 0 THEN er WHEN zr > 0 THEN zr * 0.40 ELSE 0.0 END"
    n, m = "CAST(alerts AS VARCHAR)", "upper(mode[1]) || mode[2:]"
    return f"""WITH RECURSIVE {_EV}, {_routes()}, {_SAMPLED}, {_NEAR}, {_RZ},
ne AS (SELECT near.route_id, near.mode, near.distance_km, ev.* FROM near JOIN ev USING (event_id) {'' if seed else "WHERE source <> 'seed'"}), {_weights('ne')}, {_RISK},
co AS (SELECT route_id, mode, count(DISTINCT nullif(CASE WHEN has_publishers THEN publisher ELSE source END, '')) AS n_sources, greatest(1, max(corroboration_count)) AS mc FROM ne GROUP BY ALL),
b AS (SELECT rt.route_id, rt.mode, rt.km AS route_km, coalesce(event_risk, 0.0) AS er, coalesce(event_count, 0) AS alerts, {'coalesce(zone_risk, 0.0)' if zones else '0.0::DOUBLE'} AS zr, {'coalesce(n_zones, 0)' if zones else '0'} AS n_zones, coalesce(n_sources, 0) AS ns, coalesce(mc, 1) AS mc, coalesce(dominant_label, 'none') AS dominant_label
  FROM rt LEFT JOIN risk ON rt.route_id = risk.route_id AND rt.mode = risk.mode LEFT JOIN co ON rt.route_id = co.route_id AND rt.mode = co.mode LEFT JOIN zt ON rt.route_id = zt.route_id AND rt.mode = zt.mode WHERE rt.mode IN ({modes})),
c AS (SELECT *, {risk} AS base FROM b),
e AS (SELECT *, round(least(CASE WHEN alerts > 0 AND (ns >= 3 OR mc >= 3) THEN least(base * 1.15, 1.0) WHEN alerts > 0 AND ns <= 1 AND alerts <= 2 THEN base * 0.90 ELSE base END, 1.0), 4) AS risk_score FROM c),
multi AS (SELECT route_id, mode, route_km, {_BAND.format('risk_score')} AS status, CAST(alerts AS BIGINT) AS alerts, risk_score, round(1 - risk_score, 4) AS safety_score, round(zr, 4) AS zone_risk, round(er, 4) AS event_risk, CAST(n_zones AS BIGINT) AS n_zones, dominant_label,
  CASE WHEN risk_score < 0.25 AND alerts = 0 THEN 'No significant geopolitical risk along ' || {m} || ' route'
    WHEN risk_score < 0.25 THEN 'Minor events detected near ' || {m} || ' corridor — route considered safe'
    WHEN risk_score < 0.5 THEN 'Moderate geopolitical risk on ' || {m} || ' route — ' || CASE WHEN alerts > 0 THEN {n} || ' event(s) detected' ELSE 'active risk zones on route' END
    WHEN risk_score < 0.75 THEN 'High-risk ' || {m} || ' route — ' || CASE WHEN alerts > 0 THEN 'conflict zones and ' || {n} || ' event(s) nearby' ELSE 'route passes through active conflict/choke point zones' END
    ELSE 'Critical risk on ' || {m} || ' route — ' || CASE WHEN alerts > 0 THEN 'significant conflict activity (' || {n} || ' event(s))' ELSE 'multiple high-danger zones on route' END END AS message FROM e)
"""


_TX = f"tx AS (SELECT doc_id, {domain.pick_sql(domain.TEXTS, 'doc_id')} || '. ' || coalesce(text, '') AS text FROM documents)"
_LOG = f"lo AS (SELECT {domain.pick_sql(['rss', 'gdelt', 'newsapi', 'gnews'], 'user_id')} AS source, ts, event_id AS seq, {domain.pick_sql(['ok', 'fail', '429', 'ok', 'fail', 'fail', 'exhausted'], '(event_id // 3)')} AS outcome FROM events)"


_WORD, _SPACE = r"\p{L}\p{N}_", r"\s\x0B\x{85}\p{Z}"


def _bounded(pattern: str) -> str:
    """A pattern, quoted, whose words and spaces are Unicode's."""
    out = re.sub(r"\\b(?=[\w(])", lambda _: f"(^|[^{_WORD}])", pattern)
    out = out.replace(r"\b", f"([^{_WORD}]|$)").replace(r"[\s-]", f"[{_SPACE}-]").replace(r"\s+", f"[{_SPACE}]+")
    return _text("(?i)" + out)


def _classified() -> str:
    words = ", ".join(f"({i}, '{label}', {_text(w)}, {x}::DOUBLE)" for i, label, w, x in D.keyword_rows())
    return f"""WITH {_TX}, kw(o, label, w, x) AS (VALUES {words}),
h AS (SELECT doc_id, o, label, count(*) AS c, sum(x) AS x FROM (SELECT doc_id, lower(text) AS low FROM tx) t JOIN kw ON CASE WHEN contains(t.low, kw.w) THEN regexp_matches(t.low, '(^|[^{_WORD}])' || regexp_escape(kw.w)) ELSE false END GROUP BY ALL),
s AS (SELECT doc_id, o, label, round(least(0.30 + 0.65 * (least(c / 3.0::DOUBLE, 1.0) + least(x / 3.0::DOUBLE, 1.0)) / 2, 0.95), 4) AS s FROM h),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, o) AS r FROM s) WHERE r = 1)
SELECT tx.doc_id, coalesce(b.label, 'safe') AS label, coalesce(b.s, 0.5) AS confidence FROM tx LEFT JOIN b USING (doc_id)"""


def _tagged(text: str, column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_bounded(p)}) THEN {dict(lat=a, lon=o, zone=_text(z))[column]}" for p, a, o, z in D.GEO_TAGS) + " END"


def _credibility() -> str:
    names = lambda t: ", ".join(_text(x) for x in D.TIERS[t])
    under = lambda t: "(" + " OR ".join(f"ends_with(d, '.{x}')" for x in D.TIERS[t]) + ")"
    cases = [(f"d IN ({names(t)})", D.TIER_SCORE[t], t) for t in D.TIERS] + [(under(t), D.TIER_SCORE[t] * 0.95, t) for t in ("tier1", "tier2")]
    cases += [("ends_with(d, '.gov') OR ends_with(d, '.gov.uk')", 0.75, "tier2"), ("ends_with(d, '.edu') OR ends_with(d, '.ac.uk')", 0.70, "tier2"), ("ends_with(d, '.org') OR ends_with(d, '.int')", 0.50, "tier3"), ("contains(d, 'news')", 0.45, "tier3")]
    case = lambda k, other: "CASE " + " ".join(f"WHEN {c[0]} THEN {_text(c[2]) if k == 2 else c[1]}" for c in cases) + f" ELSE {other} END"
    known = "CASE " + " ".join(f"WHEN contains(lower(p), '{n}') THEN greatest(b, {x}::DOUBLE)" for n, x in D.PUBLISHERS.items()) + " ELSE b END"
    return f"""WITH u AS (SELECT page_id, {domain.pick_sql(domain.PUBLISHERS, 'page_id')} AS p, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS d FROM pages),
s AS (SELECT *, ({case(1, 0.30)})::DOUBLE AS b, {case(2, "'unknown'")} AS t FROM u), v AS (SELECT *, {known} AS s FROM s)
SELECT page_id, d AS domain, round(s, 4) AS credibility_score, CASE WHEN s = b THEN t WHEN s >= 0.90 THEN 'tier1' WHEN s >= 0.75 THEN 'tier2' WHEN s >= 0.60 THEN 'tier3' ELSE t END AS credibility_tier, coalesce(nullif(p, ''), d) AS publisher FROM v"""


def _intensity() -> str:
    hits = " + ".join(f"CAST(contains(lower(text), '{k}') AS INTEGER)" for k in D.SEVERE_KEYWORDS)
    parts = " + ".join(f"{k} * {w}" for k, w in D.FEATURE_WEIGHTS.items())
    cols = ", ".join(f"round({k}, 6) AS {k}" for k in D.FEATURE_WEIGHTS)
    return f"""WITH {_TX}, l AS (SELECT *, {domain.pick_sql(domain.LABELS, 'doc_id')} AS label, 0.3::DOUBLE + (doc_id % 66) / 100.0::DOUBLE AS conf, {hits} AS hits FROM tx),
g AS (SELECT doc_id, ({_case(D.LABEL_SEVERITY, 'label', '0.3')})::DOUBLE AS label_severity, conf AS classifier_confidence, least((doc_id % 9) / greatest(sqrt(length(text) + 1), 1.0), 1.0) AS ner_density, least(hits / 14.0::DOUBLE, 1.0) AS keyword_intensity, least(ln(length(text) + 1.0::DOUBLE) / 10, 1.0) AS text_richness FROM l),
h AS (SELECT *, label_severity * classifier_confidence AS composite FROM g)
SELECT doc_id, {cols}, round(greatest(0.0, least(1.0, {parts})), 5) AS intensity FROM h"""


_STOP = ", ".join(_text(w) for w in D.STOPWORDS)
_ROUTED = f"WITH RECURSIVE {_routes()}"

def _sea() -> str:
    """Shortest paths over the lanes between ports: as many rounds as a path can have lanes, all pairs of ports in each."""
    lat, lon = (lambda x: f"(({x} * 37) % 120 - 50)::DOUBLE"), (lambda x: f"(({x} * 73) % 340 - 170)::DOUBLE")
    out = f"""WITH ports AS MATERIALIZED (SELECT n_nationkey::BIGINT AS k, {lat('n_nationkey')} AS lat, {lon('n_nationkey')} AS lon FROM nation WHERE n_nationkey < 23),
lane AS (SELECT a.k * 10 + far AS lane_id, a.k AS a, b.k AS b, a.k % 4 + 2 AS n, a.lat AS a1, a.lon AS o1, b.lat AS a2, b.lon AS o2 FROM ports a, (SELECT unnest([1, 5]) AS far), ports b WHERE b.k = (a.k + far) % 23),
pt AS (SELECT *, a1 + (a2 - a1) * (i / n::DOUBLE) AS lat, o1 + (o2 - o1) * (i / n::DOUBLE) AS lon FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM lane)),
sg AS (SELECT *, lag(lat) OVER w AS pa, lag(lon) OVER w AS po FROM pt WINDOW w AS (PARTITION BY lane_id ORDER BY i)),
wt AS (SELECT lane_id, any_value(a) AS a, any_value(b) AS b, any_value(n) AS n, sum({_hav('pa', 'po', 'lat', 'lon')}) AS w FROM sg GROUP BY lane_id),
ed AS MATERIALIZED (SELECT a, b, lane_id, n, w FROM wt UNION ALL SELECT b, a, lane_id, n, w FROM wt),
d0 AS (SELECT k AS s, k AS t, 0.0::DOUBLE AS km, [k] AS via, 0::BIGINT AS n, []::BIGINT[] AS lanes FROM ports)"""
    for r in range(22):
        out += f""",
d{r + 1} AS MATERIALIZED (SELECT s, t, m.km AS km, m.via AS via, m.n AS n, m.lanes AS lanes FROM (SELECT s, t, min({{'km': km, 'hops': len(lanes), 'lanes': lanes, 'via': via, 'n': n}}) AS m
  FROM (SELECT s, t, km, via, n, lanes FROM d{r} UNION ALL SELECT d.s, e.b, d.km + e.w, list_append(d.via, e.b), d.n + e.n, list_append(d.lanes, e.lane_id) FROM d{r} d JOIN ed e ON d.t = e.a) GROUP BY s, t))"""
    return (
        out
        + f""",
rq AS (SELECT s_suppkey::BIGINT AS route_id, {lat('k')} + 0.5 AS olat, {lon('k')} + 0.25 AS olon, {lat('d')} - 0.25 AS dlat, {lon('d')} + 0.5 AS dlon FROM (SELECT s_suppkey, s_nationkey AS k, (s_nationkey + s_suppkey % 24 + 1) % 25 AS d FROM supplier)),
en AS (SELECT DISTINCT olat AS lat, olon AS lon FROM rq UNION SELECT dlat, dlon FROM rq),
sn AS (SELECT e.lat, e.lon, min({{'km': {_hav('e.lat', 'e.lon', 'p.lat', 'p.lon')}, 'k': p.k}}) AS m FROM en e, ports p WHERE {_hav('e.lat', 'e.lon', 'p.lat', 'p.lon')} <= 300 GROUP BY e.lat, e.lon),
fd AS (SELECT rq.*, o.m.km + d22.km + t.m.km AS km, d22.n + 3 AS n, d22.lanes[1] AS lane, d22.s, o.m.k AS ok FROM rq JOIN sn o ON o.lat = olat AND o.lon = olon JOIN sn t ON t.lat = dlat AND t.lon = dlon JOIN d22 ON d22.s = o.m.k AND d22.t = t.m.k WHERE o.m.k <> t.m.k)
SELECT route_id, round(fd.km, 1) AS km, least(fd.n, 20)::BIGINT AS n_points,
  round(CASE WHEN fd.n <= 20 THEN p.lat ELSE u.lat END, 3) AS second_lat, round(CASE WHEN fd.n <= 20 THEN p.lon ELSE u.lon END, 3) AS second_lon, round(dlat, 3) AS last_lat, round(dlon, 3) AS last_lon
FROM fd JOIN ports p ON p.k = fd.ok
LEFT JOIN pt u ON u.lane_id = fd.lane AND u.i = CASE WHEN u.a = fd.ok THEN CAST(round_even((fd.n - 1) / 19.0::DOUBLE, 0) AS BIGINT) - 1 ELSE u.n - CAST(round_even((fd.n - 1) / 19.0::DOUBLE, 0) AS BIGINT) + 1 END"""
    )


ORACLES = {
    "zone_event_risk": f"WITH {_EV}, {_ZONES}, {_HITS}, z AS (SELECT event_id, round(least(max(base_risk) + least(0.20, (count(*) - 1) * 0.05), 0.95), 4) AS zone_risk, count(*) AS n_zones FROM hits GROUP BY event_id) SELECT *, {_BAND.format('zone_risk')} AS band FROM z",
    "event_zone_containment": f"WITH {_EV}, {_ZONES}, {_HITS} SELECT ev.event_id, coalesce(h.zones, '') AS zones FROM ev LEFT JOIN (SELECT event_id, string_agg(zone, '; ' ORDER BY round(d, 1), zone_ord) AS zones FROM hits GROUP BY event_id) h USING (event_id)",
    "zone_factor": f"WITH {_EV}, {_ZONES}, {_HITS} SELECT event_id, zone, ({_case(D.CATEGORY_FACTOR, 'category', '1.0')})::DOUBLE AS factor FROM hits",
    "event_weights": f"WITH {_GROUPS} SELECT event_id, recency_weight, proximity_weight, composite_risk FROM f",
    "minmax_normalize": f"WITH {_EV}, x AS (SELECT min(intensity_score) AS lo, max(intensity_score) AS hi FROM ev) SELECT event_id, CASE WHEN lo = hi THEN 0.5 ELSE round((intensity_score - lo) / (hi - lo), 6) END AS scaled FROM ev, x",
    "route_risk_aggregate": f"WITH {_GROUPS}, {_RISK} SELECT * FROM risk",
    "dominant_label": f"WITH {_GROUPS}, {_RISK} SELECT * FROM dom",
    "top_events": f"WITH {_GROUPS} SELECT * FROM (SELECT route_id, mode, CAST(row_number() OVER (PARTITION BY route_id, mode ORDER BY composite_risk DESC, ord) AS INTEGER) AS rank, event_id, composite_risk FROM f) WHERE rank <= 5",
    "events_by_distance": f"WITH {_GROUPS} SELECT * FROM (SELECT route_id, mode, CAST(row_number() OVER (PARTITION BY route_id, mode ORDER BY distance_km, ord) AS INTEGER) AS rank, event_id, distance_km FROM f) WHERE rank <= 50",
    "corroboration_stats": f"WITH {_GROUPS} SELECT route_id, mode, count(DISTINCT nullif(CASE WHEN has_publishers THEN publisher ELSE source END, '')) AS n_sources, greatest(1, max(corroboration_count)) AS max_corroboration FROM f GROUP BY route_id, mode",
    "route_points": f"{_ROUTED} SELECT route_id, mode, idx, round(lat, 4) AS lat, round(lon, 4) AS lon FROM pts",
    "route_length": f"{_ROUTED} SELECT route_id, mode, km, n_points, round(path, 2) AS path_km FROM rt",
    "nearest_hubs": f"WITH {_EV}, {_HUBS} SELECT event_id, CAST(arg_min(hub_ord, (d, hub_ord)) AS BIGINT) AS hub_ord, round(min(d), 2) AS km FROM (SELECT event_id, hub_ord, {_hav('lat', 'lon', 'hlat', 'hlon')} AS d FROM ev, hubs) GROUP BY event_id",
    "route_downsample": f"{_ROUTED}, {_SAMPLED} SELECT route_id, mode, wp, round(lat, 4) AS lat, round(lon, 4) AS lon FROM wp",
    "route_zone_intersections": f"{_ROUTED}, {_RZ} SELECT route_id, mode, zone, min_distance_km, closest_idx FROM rz",
    "route_zone_risk": f"{_ROUTED}, {_RZ} SELECT * FROM zt",
    "events_near_route": f"WITH RECURSIVE {_EV}, {_routes()}, {_SAMPLED}, {_NEAR} SELECT route_id, mode, event_id, wp, distance_km FROM near",
    "multi_mode_risk": f"{_multi(True, False)} SELECT * FROM multi",
    "legacy_multi_mode": f"{_multi(False, True)} SELECT * FROM multi",
    "single_mode_risk": _multi(True, False, "'sea'") + " SELECT * FROM multi",
    "recommended_mode": f"{_multi(True, False)} SELECT route_id, arg_max(mode, (safety_score, CASE mode WHEN 'air' THEN 0 WHEN 'sea' THEN -1 ELSE -2 END)) AS recommended_mode FROM multi GROUP BY route_id",
    "single_route_risk": f"WITH RECURSIVE {_EV}, {_routes(10)}, {_SAMPLED}, {_NEAR}, ne AS (SELECT near.route_id, near.mode, near.distance_km, ev.* FROM near JOIN ev USING (event_id) WHERE mode = 'air'), {_weights('ne')}, {_RISK} SELECT rt.route_id, rt.km AS route_km, coalesce(event_risk, 0.0) AS event_risk, coalesce(event_band, 'LOW') AS event_band, coalesce(event_count, 0) AS event_count, coalesce(dominant_label, 'none') AS dominant_label FROM rt LEFT JOIN risk ON rt.route_id = risk.route_id AND rt.mode = risk.mode WHERE rt.mode = 'air'",
    "evidence_top5": f"WITH RECURSIVE {_EV}, {_routes()}, {_SAMPLED}, {_NEAR}, ne AS (SELECT near.route_id, near.mode, near.distance_km, ev.* FROM near JOIN ev USING (event_id) WHERE source <> 'seed') SELECT * FROM (SELECT route_id, mode, CAST(row_number() OVER (PARTITION BY route_id, mode ORDER BY intensity_score * (1.0::DOUBLE / greatest(coalesce(distance_km, 1.0), 0.1)) DESC, ord) AS INTEGER) AS rank, event_id, trim(raw_text[1:150]) || CASE WHEN length(raw_text) > 150 THEN '…' ELSE '' END AS headline, round(label_confidence, 4) AS confidence, distance_km FROM ne) WHERE rank <= 5",
    "source_credibility": _credibility(),
    "raw_validity": f"WITH {_EV} SELECT event_id FROM ev WHERE length(trim(raw_text)) >= 20 AND regexp_matches(source_url, '^https?://') AND epoch_us({_NOW}) - epoch_us(published_at) <= 72 * 3600000000",
    "relevance_filter": f"WITH {_TX} SELECT doc_id FROM tx WHERE length(text) >= 20 AND ({' OR '.join(f'regexp_matches(text, {_bounded(f"\\b({p})\\b")})' for p in D.ACCEPT)} OR NOT ({' OR '.join(f'regexp_matches(text, {_bounded(f"\\b({p})\\b")})' for p in D.REJECT)}))",
    "ml_relevance_filter": f"WITH {_EV} SELECT event_id, label FROM ev WHERE NOT (label = 'safe' AND label_confidence >= 0.70)",
    "keyword_classify": _classified(),
    "keyword_hits": f"WITH {_TX} SELECT doc_id, CAST({' + '.join(f'CAST(contains(lower(text), {_text(k)}) AS INTEGER)' for k in D.SEVERE_KEYWORDS)} AS BIGINT) AS hits FROM tx",
    "intensity_score": _intensity(),
    "geo_tag_first": f"WITH {_TX} SELECT doc_id, ({_tagged('text', 'lat')})::DOUBLE AS lat, ({_tagged('text', 'lon')})::DOUBLE AS lon, {_tagged('text', 'zone')} AS zone FROM tx WHERE {_tagged('text', 'zone')} IS NOT NULL",
    "geo_tag_all": f"WITH {_TX}, g(o, p, z) AS (VALUES {', '.join(f'({i}, {_bounded(p)}, {_text(z)})' for i, (p, _, _, z) in enumerate(D.GEO_TAGS))}), m AS (SELECT doc_id, z, min(o) AS o FROM tx JOIN g ON regexp_matches(text, p) GROUP BY doc_id, z), a AS (SELECT doc_id, string_agg(z, '; ' ORDER BY o) AS zones FROM m GROUP BY doc_id) SELECT tx.doc_id, coalesce(zones, '') AS zones FROM tx LEFT JOIN a USING (doc_id)",
    "resolve_coordinates": f"WITH {_TX}, t AS (SELECT *, ({_tagged('text', 'lat')})::DOUBLE AS tlat, ({_tagged('text', 'lon')})::DOUBLE AS tlon, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 200) - 100.0::DOUBLE END AS flat, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 400) - 200.0::DOUBLE END AS flon FROM tx), u AS (SELECT doc_id, CASE WHEN flat BETWEEN -90 AND 90 AND flon BETWEEN -180 AND 180 THEN flat WHEN tlat IS NOT NULL THEN tlat WHEN doc_id % 2 = 0 THEN 1.5 END AS lat, CASE WHEN flat BETWEEN -90 AND 90 AND flon BETWEEN -180 AND 180 THEN flon WHEN tlat IS NOT NULL THEN tlon WHEN doc_id % 2 = 0 THEN 2.5 END AS lon FROM t) SELECT * FROM u WHERE lat IS NOT NULL",
    "token_cosine": f"""WITH {_EV}, p AS (SELECT event_id, raw_text AS a, {domain.pick_sql(domain.TEXTS, '(ord // 7)')} AS b FROM ev),
ta AS (SELECT event_id, w, count(*) AS c FROM (SELECT event_id, unnest(regexp_extract_all(lower(a), '[a-z0-9]+')) AS w FROM p) WHERE length(w) > 2 AND w NOT IN ({_STOP}) GROUP BY ALL),
tb AS (SELECT event_id, w, count(*) AS c FROM (SELECT event_id, unnest(regexp_extract_all(lower(b), '[a-z0-9]+')) AS w FROM p) WHERE length(w) > 2 AND w NOT IN ({_STOP}) GROUP BY ALL),
na AS (SELECT event_id, sqrt(sum(c * c)) AS n FROM ta GROUP BY ALL), nb AS (SELECT event_id, sqrt(sum(c * c)) AS n FROM tb GROUP BY ALL),
dt AS (SELECT ta.event_id, sum(ta.c * tb.c) AS d FROM ta JOIN tb ON ta.event_id = tb.event_id AND ta.w = tb.w GROUP BY ALL)
SELECT p.event_id, coalesce(round(dt.d / greatest(na.n * nb.n, 1e-9), 6), 0.0) AS cosine FROM p LEFT JOIN dt USING (event_id) LEFT JOIN na USING (event_id) LEFT JOIN nb USING (event_id)""",
    "headlines": f"WITH {_TX} SELECT doc_id, trim(text[1:120]) || CASE WHEN length(text) > 120 THEN '…' ELSE '' END AS headline, sha256(text)[1:16] AS hash FROM tx",
    "masked_secrets": "SELECT page_id, 'mongodb://***:***@' || regexp_replace(url, '^https?://', '') AS uri, CASE WHEN length(url) <= 8 THEN '***' ELSE url[1:4] || '...' || url[-4:] END AS secret, 'a b ' || url AS place FROM pages",
    "source_counts": f"WITH {_EV} SELECT source, count(*) AS n FROM ev GROUP BY source",
    "db_diagnostics": f"WITH {_EV} SELECT count(*) AS total, count(*) FILTER (source <> 'seed') AS non_seed, count(*) AS with_url, count(*) AS v2, 0::BIGINT AS v5, arg_max(event_id, (published_at, event_id)) AS latest_event, epoch_us(max(published_at)) AS latest_at FROM ev",
    "timing_stats": "SELECT name, count(*) AS count, round(avg(ms), 1) AS avg_ms, round(arg_max(ms, seq), 1) AS last_ms, round(max(ms), 1) AS max_ms FROM (SELECT event_type AS name, event_id AS seq, round(value, 1) AS ms, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 100 GROUP BY name",
    "success_rates": f"WITH {_LOG} SELECT source, round(avg(CASE WHEN outcome = 'ok' THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM lo GROUP BY source",
    "union_dedup": f"WITH {_EV} SELECT event_id, CASE WHEN source <> 'gdelt' THEN raw_text ELSE 'again' END AS text, CAST(CASE WHEN source <> 'gdelt' THEN 0 ELSE 1 END AS BIGINT) AS source_rank FROM ev WHERE source <> 'gdelt' OR ord % 2 = 0",
    "insert_if_absent": f"WITH {_EV} SELECT event_id, source FROM ev WHERE ord % 3 <> 0",
    "purge_seed": f"WITH {_EV} SELECT event_id, source FROM ev WHERE source <> 'seed'",
    "ttl_retention": f"WITH {_EV} SELECT event_id FROM ev WHERE epoch_us(published_at) > epoch_us({_NOW}) - 72 * 3600000000",
    "rolling_quota": f"WITH {_LOG} SELECT source, seq, count(*) OVER (PARTITION BY source ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS used FROM lo",
    "failure_runs": f"WITH {_LOG}, i AS (SELECT *, sum(CAST(outcome = 'ok' AS INTEGER)) OVER (PARTITION BY source ORDER BY ts, seq) AS island FROM lo) SELECT source, seq, CAST(sum(CAST(outcome <> 'ok' AS INTEGER)) OVER (PARTITION BY source, island ORDER BY ts, seq) AS BIGINT) AS run FROM i",
    "rotated_queries": f"SELECT event_id, {domain.pick_sql(ROTATION, 'event_id')} AS q FROM events",
    "rss_items": "SELECT page_id, 'Page ' || page_id AS title, 'About ' || (page_id * 2) AS description, url AS link, 'http://img/' || page_id || '.png' AS image_url FROM pages",
    "route_legs": f"{_ROUTED} SELECT route_id, mode, idx, round(seg, 3) AS km FROM sg",
    "intensity_training_set": f"WITH {_EV}, t AS (SELECT event_id, ({_case(D.LABEL_SEVERITY, 'label', '0.3')})::DOUBLE AS label_severity, label_confidence AS classifier_confidence, 0.0::DOUBLE AS ner_density, 0.0::DOUBLE AS keyword_intensity, least(ln(length(raw_text) + 1.0::DOUBLE) / 10, 1.0) AS text_richness, intensity_score FROM ev WHERE label_confidence >= 0.7) SELECT event_id, round(label_severity, 6) AS label_severity, round(classifier_confidence, 6) AS classifier_confidence, ner_density, keyword_intensity, round(text_richness, 6) AS text_richness, round(label_severity * classifier_confidence, 6) AS composite, CAST(intensity_score >= 0.5 AS INTEGER) AS y FROM t",
    "seed_events": f"SELECT 'seed-' || i AS event_id, {domain.pick_sql(domain.TEXTS, 'i')} AS text, 'seed' AS source, {domain.pick_sql(domain.LABELS, '(i % 24)')} AS label FROM range(100) r(i)",
    "json_response": f"{_multi(True, False)} SELECT route_id, '{{' || string_agg('\"' || mode || '\":{{\"status\":\"' || status || '\",\"alerts\":' || alerts || '}}', ',' ORDER BY mode) || '}}' AS response FROM multi GROUP BY route_id",
    "entity_normalize": "SELECT event_id, (['United States', 'Ukraine', 'Cairo', '', '', 'U.S', '', 'Red Sea', '', 'Iran'])[CAST(event_id % 10 AS INTEGER) + 1] AS place FROM events",
    "cycle_stats": f"""WITH {_EV}, ok AS (SELECT * FROM ev WHERE length(trim(raw_text)) >= 20 AND epoch_us({_NOW}) - epoch_us(published_at) <= 72 * 3600000000),
c AS (SELECT (SELECT count(*) FROM ev) AS f, (SELECT count(*) FROM ok) AS e, (SELECT count(*) FROM (SELECT DISTINCT source, raw_text FROM ok)) AS w)
SELECT unnest(['fetched', 'enriched', 'skipped', 'written', 'clustered_from', 'clustered_to', 'duplicates_merged']) AS metric, unnest([f, e, f - e, w, e, w, greatest(0, e - w)]) AS n FROM c
UNION ALL SELECT 'source_' || source, count(*) FROM ev GROUP BY source""",
    "latest_verified": f"WITH {_EV} SELECT event_id, round(0.3 + (ord % 5) / 10.0::DOUBLE, 4) AS credibility_score FROM ev WHERE ord % 3 > 0 ORDER BY published_at DESC, event_id LIMIT 5",
    "api_latency": "SELECT event_type AS path, count(*) AS requests, count(*) FILTER (event_id % 17 = 0) AS errors, round(avg(round(value, 1)), 2) AS avg_ms, round(max(round(value, 1)), 2) AS max_ms FROM events GROUP BY ROLLUP (event_type)",
    "mode_events": f"WITH {_GROUPS} SELECT * FROM (SELECT route_id, mode, CAST(row_number() OVER (PARTITION BY route_id, mode ORDER BY distance_km, ord) AS INTEGER) AS rank, trim(raw_text[:120]) || CASE WHEN length(raw_text) > 120 THEN '…' ELSE '' END AS headline, distance_km, round(intensity_score, 6) AS intensity, label FROM f) WHERE rank <= 5",
    "route_locations": f"""WITH {_GROUPS}, l AS (SELECT route_id, mode, ord, 0 AS k, {domain.pick_sql(['Kyiv', 'Red Sea', 'Aden', 'Suez Canal', 'Gaza', 'Taiwan', 'Sahel'], 'ord')} AS name FROM f
  UNION ALL SELECT route_id, mode, ord, 1, {domain.pick_sql(['Kyiv', 'Red Sea', 'Aden', 'Suez Canal', 'Gaza', 'Taiwan', 'Sahel'], '(ord // 5)')} FROM f),
m AS (SELECT route_id, mode, name, min(ord * 2 + k) AS first FROM l GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY route_id, mode ORDER BY first) AS r FROM m)
SELECT route_id, mode, string_agg(name, '; ' ORDER BY r) AS locations FROM n WHERE r <= 4 GROUP BY route_id, mode""",
    "even_samples": f"""{_ROUTED}, c AS (SELECT *, count(*) OVER (PARTITION BY route_id, mode) AS n FROM pts),
k AS (SELECT route_id, mode, n, unnest(range(0, 20)) AS i FROM (SELECT DISTINCT route_id, mode, n FROM c WHERE n > 20)),
w AS (SELECT route_id, mode, i, CAST(round_even(i * ((n - 1) / 19.0::DOUBLE), 0) AS BIGINT) AS at FROM k)
SELECT route_id, mode, idx, round(lat, 4) AS lat, round(lon, 4) AS lon FROM c WHERE n <= 20
UNION ALL SELECT w.route_id, w.mode, w.i, round(c.lat, 4), round(c.lon, 4) FROM w JOIN c ON c.route_id = w.route_id AND c.mode = w.mode AND c.idx = w.at""",
    "sea_lanes": f"""WITH p AS (SELECT CAST(n_nationkey AS BIGINT) AS route_id, unnest(range(0, 11 + n_nationkey)) AS j FROM nation),
q AS (SELECT route_id, j, route_id * 2.0::DOUBLE - 20 + j * 0.75::DOUBLE AS lat, route_id * 11.0::DOUBLE - 120 + j * 0.5::DOUBLE AS lon, count(*) OVER (PARTITION BY route_id) AS n FROM p),
g AS (SELECT *, lag(lat) OVER (PARTITION BY route_id ORDER BY j) AS a, lag(lon) OVER (PARTITION BY route_id ORDER BY j) AS b FROM q),
t AS (SELECT route_id, round(sum({_hav('a', 'b', 'lat', 'lon')}), 1) AS km FROM g GROUP BY route_id),
s AS (SELECT route_id, j AS idx, j AS at FROM q WHERE n <= 20 UNION ALL SELECT route_id, i, CAST(round_even(i * ((n - 1) / 19.0::DOUBLE), 0) AS BIGINT) FROM (SELECT DISTINCT route_id, n, unnest(range(0, 20)) AS i FROM (SELECT DISTINCT route_id, n FROM q WHERE n > 20)))
SELECT s.route_id, t.km, s.idx, q.lat, q.lon FROM s JOIN q ON q.route_id = s.route_id AND q.j = s.at JOIN t ON t.route_id = s.route_id""",
    "sea_routes": _sea(),
    "backoff_seconds": "SELECT event_id, round(greatest(0.5, least(2.0 * power(2.0, event_id % 9) * (1 + 0.5 * ((event_id % 21) / 10.0::DOUBLE - 1)), 300.0)), 6) AS seconds FROM events",
}
