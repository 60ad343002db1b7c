"""Named queries over the tables, one or more for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayrisk.functions import risk as R
from wayrisk.functions import text as T
from wayrisk.functions.geo import haversine_km, path_km
from wayrisk.functions.python_text import headline_similarity, place_or_empty, places_udf, unique_places
from wayrisk.operators import aggregates as agg
from wayrisk.operators import clusters, state
from wayrisk.operators.cut import cut
from wayrisk.operators.joins import ROUTE, events_near, event_zones, route_zones, zone_hits
from wayrisk.operators.routes import evenly_sampled, lane_routes, nearest_hub, points_of, routes, sampled
from wayrisk.operators.sea import sea_routes as by_sea
from wayrisk.plans import analysis, domain, ingest, learned
from wayrisk.plans.domain import now
from wayrisk.sources import dimensions as D
from wayrisk.sources import feeds, sinks

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _scored(s: SparkSession, d: str) -> DataFrame:
    """Events at a distance that follows from their id, in 40 groups."""
    i = F.col("ord")
    e = domain.events(s, d).withColumns({"distance_km": ((i * 31) % 4000) / 10.0, "route_id": i % 20, "mode": domain.pick(["air", "sea"], F.floor(i / 20))})
    return agg.features(e, now())


@query
def zone_event_risk(s: SparkSession, d: str) -> DataFrame:
    z = domain.events(s, d).select("event_id", F.explode(zone_hits(F.col("lat"), F.col("lon"))).alias("z")).select("event_id", "z.base_risk")
    t = agg.zone_totals(z, ["event_id"])
    return t.select("event_id", "zone_risk", F.col("n_zones").cast("long").alias("n_zones"), R.band(F.col("zone_risk")).alias("band"))


@query
def event_zone_containment(s: SparkSession, d: str) -> DataFrame:
    return event_zones(domain.events(s, d)).select("event_id", F.array_join("zones", "; ").alias("zones"))


@query
def zone_factor(s: SparkSession, d: str) -> DataFrame:
    z = domain.events(s, d).select("event_id", F.explode(zone_hits(F.col("lat"), F.col("lon"))).alias("z"))
    return z.select("event_id", "z.zone", R.zone_factor(F.col("z.category")).alias("factor"))


@query
def event_weights(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select("event_id", "recency_weight", "proximity_weight", "composite_risk")


@query
def minmax_normalize(s: SparkSession, d: str) -> DataFrame:
    return agg.min_max(domain.events(s, d).select("event_id", "intensity_score"), "intensity_score", "scaled").select("event_id", "scaled")


@query
def route_risk_aggregate(s: SparkSession, d: str) -> DataFrame:
    return agg.route_risk(_scored(s, d)).withColumn("event_count", F.col("event_count").cast("long"))


@query
def dominant_label(s: SparkSession, d: str) -> DataFrame:
    return agg.dominant_label(agg.ranked(_scored(s, d)))


@query
def top_events(s: SparkSession, d: str) -> DataFrame:
    return analysis.top_events(_scored(s, d)).select(*ROUTE, "rank", "event_id", "composite_risk")


@query
def events_by_distance(s: SparkSession, d: str) -> DataFrame:
    return analysis.nearest_events(_scored(s, d), 50).select(*ROUTE, "rank", "event_id", "distance_km")


@query
def corroboration_stats(s: SparkSession, d: str) -> DataFrame:
    return agg.corroboration(_scored(s, d)).withColumn("max_corroboration", F.col("max_corroboration").cast("long"))


@query
def route_points(s: SparkSession, d: str) -> DataFrame:
    p = points_of(routes(domain.requests(s, d)))
    return p.select(*ROUTE, F.col("idx").cast("long").alias("idx"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query
def route_length(s: SparkSession, d: str) -> DataFrame:
    r = routes(domain.requests(s, d))
    return r.select(*ROUTE, "km", F.size("points").cast("long").alias("n_points"), F.round(path_km(F.col("points")), 2).alias("path_km"))


@query
def nearest_hubs(s: SparkSession, d: str) -> DataFrame:
    h = nearest_hub(F.col("lat"), F.col("lon"))
    return domain.events(s, d).select("event_id", h["ord"].cast("long").alias("hub_ord"), F.round(h["d"], 2).alias("km"))


@query
def route_downsample(s: SparkSession, d: str) -> DataFrame:
    p = points_of(sampled(routes(domain.requests(s, d))))
    return p.select(*ROUTE, F.col("idx").cast("long").alias("wp"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query
def route_zone_intersections(s: SparkSession, d: str) -> DataFrame:
    z = route_zones(points_of(routes(domain.requests(s, d))), D.zones(s))
    return z.select(*ROUTE, "zone", "min_distance_km", F.col("closest_idx").cast("long").alias("closest_idx"))


@query
def route_zone_risk(s: SparkSession, d: str) -> DataFrame:
    z = route_zones(points_of(routes(domain.requests(s, d))), D.zones(s))
    return agg.zone_totals(z).withColumn("n_zones", F.col("n_zones").cast("long"))


@query
def events_near_route(s: SparkSession, d: str) -> DataFrame:
    near = events_near(routes(domain.requests(s, d)), domain.events(s, d))
    return near.select(*ROUTE, "event_id", F.col("wp").cast("long").alias("wp"), "distance_km")


@query
def multi_mode_risk(s: SparkSession, d: str) -> DataFrame:
    return analysis.multi_mode(domain.requests(s, d), domain.events(s, d), now())


@query
def legacy_multi_mode(s: SparkSession, d: str) -> DataFrame:
    return analysis.multi_mode(domain.requests(s, d), domain.events(s, d), now(), settings=analysis.Settings(use_zones=False, drop_seed=False))


@query
def single_mode_risk(s: SparkSession, d: str) -> DataFrame:
    return analysis.multi_mode(domain.requests(s, d), domain.events(s, d), now(), modes=["sea"])


@query
def single_route_risk(s: SparkSession, d: str) -> DataFrame:
    out = analysis.single_route(domain.requests(s, d), domain.events(s, d), now())
    return out.select("route_id", "route_km", "event_risk", "event_band", F.col("event_count").cast("long").alias("event_count"), "dominant_label")


@query
def recommended_mode(s: SparkSession, d: str) -> DataFrame:
    return agg.recommended(multi_mode_risk(s, d))


@query
def evidence_top5(s: SparkSession, d: str) -> DataFrame:
    near = analysis.near_events(routes(domain.requests(s, d)), domain.events(s, d), analysis.Settings())
    return analysis.evidence(near).select(*ROUTE, "rank", "event_id", "headline", "confidence", "distance_km")


@query
def json_response(s: SparkSession, d: str) -> DataFrame:
    return sinks.response(multi_mode_risk(s, d).select(*ROUTE, "status", "alerts"))


@query
def source_credibility(s: SparkSession, d: str) -> DataFrame:
    p = domain.table(s, d, "pages").select("page_id", T.verify(F.col("url"), domain.pick(domain.PUBLISHERS, F.col("page_id"))).alias("v"))
    return p.select("page_id", "v.domain", "v.credibility_score", "v.credibility_tier", "v.publisher")


@query
def raw_validity(s: SparkSession, d: str) -> DataFrame:
    e = domain.events(s, d)
    return e.where(T.valid_event(F.col("raw_text"), F.col("source_url"), F.col("published_at"), now())).select("event_id")


@query
def relevance_filter(s: SparkSession, d: str) -> DataFrame:
    return domain.texts(s, d).where(T.relevant(F.col("text"))).select("doc_id")


@query
def ml_relevance_filter(s: SparkSession, d: str) -> DataFrame:
    return domain.events(s, d).where(T.still_relevant(F.col("label"), F.col("label_confidence"))).select("event_id", "label")


@query
def keyword_classify(s: SparkSession, d: str) -> DataFrame:
    return domain.texts(s, d).select("doc_id", T.classify(F.col("text")).alias("c")).select("doc_id", "c.label", "c.confidence")


@query
def keyword_hits(s: SparkSession, d: str) -> DataFrame:
    return domain.texts(s, d).select("doc_id", R.severe_hits(F.col("text")).cast("long").alias("hits"))


@query
def intensity_score(s: SparkSession, d: str) -> DataFrame:
    t = domain.texts(s, d).withColumn("label", domain.pick(domain.LABELS, F.col("doc_id")))
    f = R.intensity_features(F.col("label"), 0.3 + (F.col("doc_id") % 66) / 100.0, F.col("doc_id") % 9, R.severe_hits(F.col("text")), F.length("text"))
    return t.select("doc_id", *(F.round(v.cast("double"), 6).alias(k) for k, v in f.items()), F.round(R.rule_intensity(f), 5).alias("intensity"))


@query
def geo_tag_first(s: SparkSession, d: str) -> DataFrame:
    return domain.texts(s, d).select("doc_id", T.geo_tag(F.col("text")).alias("g")).where("g is not null").select("doc_id", "g.lat", "g.lon", "g.zone")


@query
def geo_tag_all(s: SparkSession, d: str) -> DataFrame:
    return domain.texts(s, d).select("doc_id", F.array_join(T.geo_tags(F.col("text")), "; ").alias("zones"))


@query
def resolve_coordinates(s: SparkSession, d: str) -> DataFrame:
    t = domain.texts(s, d)
    i = F.col("doc_id")
    lat, lon = F.when(i % 3 == 0, (i % 200) - 100.0), F.when(i % 3 == 0, (i % 400) - 200.0)
    g = T.resolve(lat, lon, F.col("text"), F.when(i % 2 == 0, F.lit(1.5)), F.when(i % 2 == 0, F.lit(2.5)))
    return t.select("doc_id", g.alias("g")).where("g is not null").select("doc_id", "g.lat", "g.lon")


@query
def token_cosine(s: SparkSession, d: str) -> DataFrame:
    e = domain.events(s, d).select("event_id", "raw_text", domain.pick(domain.TEXTS, F.floor(F.col("ord") / 7)).alias("other"))
    return e.select("event_id", F.round(T.token_cosine(F.col("raw_text"), F.col("other")), 6).alias("cosine"))


@query
def headlines(s: SparkSession, d: str) -> DataFrame:
    return domain.texts(s, d).select("doc_id", T.headline(F.col("text"), 120).alias("headline"), T.short_hash(F.col("text")).alias("hash"))


@query
def masked_secrets(s: SparkSession, d: str) -> DataFrame:
    p = domain.table(s, d, "pages")
    uri = F.concat(F.lit("mongodb://user:pw@"), F.regexp_replace("url", "^https?://", ""))
    return p.select("page_id", T.masked_uri(uri).alias("uri"), T.masked_secret(F.col("url")).alias("secret"), T.clean_location(F.concat(F.lit("  a \t b "), F.col("url"))).alias("place"))


@query
def source_counts(s: SparkSession, d: str) -> DataFrame:
    return agg.source_counts(domain.events(s, d))


@query
def db_diagnostics(s: SparkSession, d: str) -> DataFrame:
    return agg.diagnostics(domain.events(s, d)).withColumn("latest_at", F.unix_micros("latest_at"))


@query
def timing_stats(s: SparkSession, d: str) -> DataFrame:
    t = domain.table(s, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), F.round(F.col("value"), 1).alias("ms"))
    return agg.timing_stats(t)


@query
def success_rates(s: SparkSession, d: str) -> DataFrame:
    return agg.success_rate(domain.fetch_log(s, d)).withColumn("success_rate", F.round("success_rate", 6))


@query
def union_dedup(s: SparkSession, d: str) -> DataFrame:
    e = domain.events(s, d).select("event_id", F.col("raw_text").alias("text"), "source")
    again = e.where(F.col("event_id").cast("long") % 2 == 0).withColumn("text", F.lit("again"))
    return feeds.fan_in([e.where("source <> 'gdelt'"), again]).select("event_id", "text", F.col("source_rank").cast("long").alias("source_rank"))


@query
def insert_if_absent(s: SparkSession, d: str) -> DataFrame:
    e = domain.events(s, d)
    return sinks.absent(e, e.where("ord % 3 = 0")).select("event_id", "source")


@query
def purge_seed(s: SparkSession, d: str) -> DataFrame:
    return sinks.without_source(domain.events(s, d)).select("event_id", "source")


@query
def ttl_retention(s: SparkSession, d: str) -> DataFrame:
    return sinks.live(domain.events(s, d).withColumn("ingested_at", F.col("published_at")), now()).select("event_id")


@query
def rolling_quota(s: SparkSession, d: str) -> DataFrame:
    return state.rolling_requests(domain.fetch_log(s, d)).select("source", "seq", "used")


@query
def failure_runs(s: SparkSession, d: str) -> DataFrame:
    return state.failure_runs(domain.fetch_log(s, d)).select("source", "seq", "run")


@query
def can_fetch_state(s: SparkSession, d: str) -> DataFrame:
    return state.states(domain.fetch_log(s, d)).select(*state.SHOWN)


@query
def rotated_queries(s: SparkSession, d: str) -> DataFrame:
    return domain.table(s, d, "events").select("event_id", feeds.rotated_query(F.col("event_id")).alias("q"))


@query
def rss_items(s: SparkSession, d: str) -> DataFrame:
    p = domain.table(s, d, "pages")
    item = F.concat(F.lit("<rss><item><title><![CDATA[Page "), F.col("page_id"), F.lit("]]></title><link>"), F.col("url"), F.lit("</link><description>About <b>"), F.col("page_id") * 2, F.lit('</b></description><enclosure url="http://img/'), F.col("page_id"), F.lit('.png"/></item></rss>'))
    return feeds.rss_items(p.select("page_id", item.alias("xml"))).select("page_id", "title", "description", "link", "image_url")


@query
def route_legs(s: SparkSession, d: str) -> DataFrame:
    """Distances between neighbouring points."""
    p = points_of(routes(domain.requests(s, d)))
    w = Window.partitionBy(*ROUTE).orderBy("idx")
    leg = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return p.select(*ROUTE, F.col("idx").cast("long").alias("idx"), F.round(leg, 3).alias("km"))


@query
def intensity_training_set(s: SparkSession, d: str) -> DataFrame:
    return learned.training_set(domain.events(s, d))


@query
def intensity_model(s: SparkSession, d: str) -> DataFrame:
    e = domain.events(s, d)
    return learned.score(e, learned.fit(learned.training_set(e)))


@query
def regex_ner(s: SparkSession, d: str) -> DataFrame:
    """Places named by texts, each with its span."""
    found = domain.texts(s, d).select("doc_id", places_udf()(F.col("text")).alias("f"))
    return found.select("doc_id", F.posexplode("f").alias("i", "p")).select("doc_id", F.col("i").cast("long").alias("i"), "p.text", "p.start", "p.end")


@query
def unique_locations(s: SparkSession, d: str) -> DataFrame:
    found = domain.texts(s, d).select("doc_id", places_udf()(F.col("text")).alias("f"))
    return found.select("doc_id", F.array_join(unique_places(F.transform("f", lambda x: x["text"])), "; ").alias("places"))


@query
def entity_normalize(s: SparkSession, d: str) -> DataFrame:
    names = ["US", "ukraine", "  Cairo  ", "NATO", "2026", "U.S.", "###", "red sea", "BREAKING", "Iran's"]
    e = domain.table(s, d, "events").select("event_id", domain.pick(names, F.col("event_id")).alias("raw"))
    return e.select("event_id", place_or_empty("raw").alias("place"))


@query
def headline_similarities(s: SparkSession, d: str) -> DataFrame:
    e = domain.events(s, d).select("event_id", "raw_text", domain.pick(domain.TEXTS, F.floor(F.col("ord") / 7)).alias("other"))
    return e.select("event_id", F.round(headline_similarity("raw_text", "other"), 6).alias("similarity"))


@query
def incident_clusters(s: SparkSession, d: str) -> DataFrame:
    """Reports at a few places, so that many are of one incident."""
    e = domain.events(s, d)
    e = e.withColumns({"lat": F.round(F.col("lat") / 20) * 20, "lon": F.round(F.col("lon") / 20) * 20})
    return clusters.cluster_incidents(e).select("canonical_event_id", "cluster", "cluster_size", "corroboration_count", "corroboration_score", "intensity_score", F.array_join("publishers", "; ").alias("publishers"))


def _raw(s: SparkSession, d: str) -> DataFrame:
    e = domain.events(s, d)
    return e.select("event_id", F.col("raw_text").alias("text"), "source", "source_url", "publisher", "image_url", "published_at", F.when(F.col("ord") % 2 == 0, F.col("lat")).alias("lat"), F.when(F.col("ord") % 2 == 0, F.col("lon")).alias("lon"))


@query
def ingest_cycle(s: SparkSession, d: str) -> DataFrame:
    out = ingest.cycle(_raw(s, d), now(), D.gazetteer(s))
    return out.select("event_id", "representative_headline", "label", "lat", "lon", "corroboration_count", "cluster_size")


@query
def cycle_counts(s: SparkSession, d: str) -> DataFrame:
    """What a cycle counted as it ran: each step's events, skips by reason, sources and incidents."""
    counts = ingest.Counts()
    cut(ingest.cycle(_raw(s, d), now(), D.gazetteer(s), counts=counts))
    return counts.table(s)


@query
def cycle_stats(s: SparkSession, d: str) -> DataFrame:
    """Counts of a cycle in which valid events of each source and text are one incident."""
    e = domain.events(s, d)
    kept = e.where(T.valid_event(F.col("raw_text"), F.col("source_url"), F.col("published_at"), now()))
    return ingest.cycle_stats(e, kept, kept.select("source", "raw_text").distinct())


@query
def latest_verified(s: SparkSession, d: str) -> DataFrame:
    e = domain.events(s, d).withColumn("ingested_at", F.col("published_at"))
    return agg.latest_verified(e.withColumn("credibility_score", F.when(F.col("ord") % 3 > 0, F.col("credibility_score")))).select("event_id", F.round("credibility_score", 4).alias("credibility_score"))


@query
def api_latency(s: SparkSession, d: str) -> DataFrame:
    e = domain.table(s, d, "events")
    log = e.select(F.col("event_type").alias("path"), F.when(F.col("event_id") % 17 == 0, 503).otherwise(200).alias("status"), F.round("value", 1).alias("ms"))
    return agg.api_latency(log)


@query
def mode_events(s: SparkSession, d: str) -> DataFrame:
    """The nearest events of each group, as the older answers hold them."""
    e = analysis.mode_events(_scored(s, d)).select(*ROUTE, F.inline("events"))
    return e.select(*ROUTE, "rank", "headline", "distance_km", F.round("intensity", 6).alias("intensity"), "label")


@query
def route_locations(s: SparkSession, d: str) -> DataFrame:
    names = ["Kyiv", "Red Sea", "Aden", "Suez Canal", "Gaza", "Taiwan", "Sahel"]
    e = _scored(s, d).withColumn("location_names", F.array(domain.pick(names, F.col("ord")), domain.pick(names, F.floor(F.col("ord") / 5))))
    return analysis.place_names(e, most=4).select(*ROUTE, F.array_join("locations", "; ").alias("locations"))


@query
def even_samples(s: SparkSession, d: str) -> DataFrame:
    r = routes(domain.requests(s, d)).withColumn("points", evenly_sampled(F.col("points")))
    return points_of(r).select(*ROUTE, F.col("idx").cast("long").alias("idx"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query
def sea_lanes(s: SparkSession, d: str) -> DataFrame:
    """Routes along given lanes: of each nation, a lane with as many points as its key has over ten."""
    k = F.col("n_nationkey").cast("long")
    lanes = domain.table(s, d, "nation").select(k.alias("route_id"), F.explode(F.sequence(F.lit(0), (10 + k).cast("int"))).alias("idx"))
    lanes = lanes.select("route_id", "idx", (F.col("route_id") * 2.0 - 20 + F.col("idx") * 0.75).alias("lat"), (F.col("route_id") * 11.0 - 120 + F.col("idx") * 0.5).alias("lon"))
    return lane_routes(lanes).select("route_id", "km", F.posexplode("points").alias("idx", "p")).select("route_id", "km", F.col("idx").cast("long").alias("idx"), "p.lat", "p.lon")


@query
def sea_routes(s: SparkSession, d: str) -> DataFrame:
    """The shortest ways of shipments over the lanes between ports, where lanes join their ends."""
    r = by_sea(domain.shipments(s, d), domain.lanes(s, d))
    return r.select("route_id", "km", F.size("points").cast("long").alias("n_points"), *(F.round(F.element_at("points", k)[x], 3).alias(name + x) for name, k in (("second_", 2), ("last_", -1)) for x in ("lat", "lon")))


@query
def sea_lane_risk(s: SparkSession, d: str) -> DataFrame:
    """Risk of each nation's route by sea over lanes, beside the other modes."""
    return analysis.multi_mode(domain.requests(s, d), domain.events(s, d), now(), lanes=domain.lanes(s, d)).select("route_id", "mode", "route_km", "status", "alerts", "n_zones")


@query
def backoff_seconds(s: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return domain.table(s, d, "events").select("event_id", F.round(R.backoff((i % 9).cast("double"), (i % 21) / 10.0 - 1), 6).alias("seconds"))


@query
def seed_events(s: SparkSession, d: str) -> DataFrame:
    t = s.createDataFrame([(i, x, 10.0 + i, 20.0 + i, domain.LABELS[i % 12], 0.5) for i, x in enumerate(domain.TEXTS)], "ord int, text string, lat double, lon double, label string, intensity_score double")
    return feeds.seed_events(s, t, 100, now()).select("event_id", "text", "source", "label")

