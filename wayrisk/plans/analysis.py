"""Route analyses over the event store: all routes and modes in one plan."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.functions.risk import band, combined_risk, message
from wayrisk.functions.text import clean_location, headline
from wayrisk.operators import aggregates as agg
from wayrisk.operators.cut import cut
from wayrisk.operators.joins import ROUTE, events_near, route_zones
from wayrisk.operators.routes import base_routes, points_of, routes
from wayrisk.operators.sea import over_lanes, sea_routes
from wayrisk.sources.dimensions import MODES, zones
from wayrisk.sources.sinks import without_source


@dataclass(frozen=True)
class Settings:
    """Parameters of an analysis (S13), with the ranges they must be in."""

    radius_km: float = 50.0
    results: int = 200
    min_confidence: float = 0.5
    use_zones: bool = True
    drop_seed: bool = True

    def __post_init__(self) -> None:
        if not 1 <= self.radius_km <= 500:
            raise ValueError("radius_km must be from 1 to 500")
        if not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence must be from 0 to 1")
        if self.results < 1:
            raise ValueError("results must be positive")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, **rest) -> Settings:
        """Settings that environment variables may change; what can't be read as a number is an error."""
        env = dict(os.environ) if env is None else env
        names = {"radius_km": "ROUTE_BUFFER_KM", "min_confidence": "MIN_LABEL_CONFIDENCE"}
        return cls(**{k: float(env[v]) for k, v in names.items() if v in env} | rest)


# What a store's address holds if nobody has filled it in.
PLACEHOLDERS = ["<username>", "<password>", "<your-password>", "<cluster>", "username:password", "your-cluster-url", "your-database"]


def store_path(path: str | None) -> str:
    """A store's address (P10): not empty, without a placeholder, and of a scheme, if it has one, that is spelt as one."""
    if not path or not path.strip():
        raise ValueError("the store's path is empty")
    found = next((p for p in PLACEHOLDERS if p in path.lower()), None)
    if found:
        raise ValueError(f"the store's path still has the placeholder {found!r}")
    if "://" in path and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/]*/?", path):
        raise ValueError("the store's path has no valid scheme")
    return path


def location(text: str) -> str:
    """A request's place name: white space collapsed, 2 to 160 characters."""
    out = " ".join(text.split())
    if not 2 <= len(out) <= 160 or "\0" in out:
        raise ValueError("a location has 2 to 160 characters")
    return out


def geocode(names: DataFrame, gazetteer: DataFrame, column: str = "name") -> DataFrame:
    """``names`` with glat and glon, null if unknown."""
    key = F.lower(clean_location(F.col(column)))
    return names.withColumn("__key", key).join(gazetteer.withColumnRenamed("name", "__key"), "__key", "left").drop("__key")


def near_events(routes_: DataFrame, events: DataFrame, settings: Settings) -> DataFrame:
    """Events of each route and mode with their distance; the seed's go after the caps."""
    near = events_near(routes_, events, settings.radius_km, settings.results, settings.min_confidence)
    found = near.join(events, "event_id")
    return without_source(found) if settings.drop_seed else found


def evidence(near: DataFrame, limit: int = 5, keys: list[str] = ROUTE) -> DataFrame:
    """The events of each group with most intensity for their distance."""
    weight = F.col("intensity_score") * (1.0 / F.greatest(F.coalesce("distance_km", F.lit(1.0)), F.lit(0.1)))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(weight), "ord"))).where(F.col("rank") <= limit)
    return ranked.select(*keys, "rank", "event_id", headline(F.col("raw_text"), 150).alias("headline"), "source_url", "publisher", "label", F.round("label_confidence", 4).alias("confidence"), F.round("intensity_score", 4).alias("intensity"), "distance_km", "lat", "lon", "corroboration_count")


def nearest_events(near: DataFrame, limit: int, keys: list[str] = ROUTE) -> DataFrame:
    """The events of each group by distance; those without come last (O2, O3)."""
    order = F.coalesce("distance_km", F.lit(9999.0))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "ord"))).where(F.col("rank") <= limit)


def top_events(scored: DataFrame, limit: int = 5, keys: list[str] = ROUTE) -> DataFrame:
    """The events of each group by composite risk (O1)."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("composite_risk"), "ord"))).where(F.col("rank") <= limit)


def place_names(events: DataFrame, keys: list[str] = ROUTE, most: int = 20) -> DataFrame:
    """keys, locations: distinct place names in the order of events."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "location_names")))
    return events.groupBy(*keys).agg(F.slice(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["location_names"]))), 1, most).alias("locations"))


def mode_events(near: DataFrame, limit: int = 5, keys: list[str] = ROUTE) -> DataFrame:
    """keys, events: an array of the nearest events, as the older answers hold them (O3)."""
    n = nearest_events(near, limit, keys)
    event = F.struct("rank", headline(F.col("raw_text"), 120).alias("headline"), "lat", "lon", F.coalesce("distance_km", F.lit(0.0)).alias("distance_km"), F.col("intensity_score").alias("intensity"), "label")
    return n.groupBy(*keys).agg(F.array_sort(F.collect_list(event)).alias("events"))


def multi_mode(requests: DataFrame, events: DataFrame, now: Column, modes: list[str] = MODES, settings: Settings | None = None, payload: bool = False, lanes: DataFrame | None = None) -> DataFrame:
    """One row per route and mode (Q3, Q4; Q5 with one mode): risks, band, message, distance and counts.

    Routes by sea follow ``lanes`` (lane_id, idx, lat, lon) where these are given and join both ends, else the arc.

    A mode without a route (an end that isn't known) has status UNKNOWN and no scores, so it is never recommended.
    With ``payload``, also the nearest events.
    """
    settings = settings or Settings()
    found = routes(requests, modes)
    if lanes is not None and "sea" in modes:
        found = over_lanes(found, sea_routes(requests, lanes))
    r = cut(found)  # a few dozen points of each route, used four times (R9)
    near = cut(near_events(r, events, settings))  # a few hundred events of each route
    out = r.select(*ROUTE, F.col("km").alias("route_km")).join(agg.route_risk(agg.features(near, now)), ROUTE, "left").join(agg.corroboration(near), ROUTE, "left")
    if settings.use_zones:
        out = out.join(agg.zone_totals(route_zones(points_of(r), zones(requests.sparkSession))), ROUTE, "left")
    else:
        out = out.withColumns({"zone_risk": F.lit(0.0), "n_zones": F.lit(0)})
    out = out.fillna({"event_risk": 0.0, "event_count": 0, "zone_risk": 0.0, "n_zones": 0, "n_sources": 0, "max_corroboration": 1, "dominant_label": "none", "event_band": "LOW"})
    both = combined_risk(F.col("event_risk"), F.col("zone_risk"), F.col("event_count"), F.col("n_sources"), F.col("max_corroboration"))
    out = out.withColumn("risk_score", both)
    out = out.select(
        *ROUTE, "route_km", band(F.col("risk_score")).alias("status"), F.col("event_count").cast("long").alias("alerts"), "risk_score", F.round(1 - F.col("risk_score"), 4).alias("safety_score"),
        F.round("zone_risk", 4).alias("zone_risk"), F.round("event_risk", 4).alias("event_risk"), F.col("n_zones").cast("long").alias("n_zones"), "dominant_label",
        message(F.col("event_count"), F.col("risk_score"), F.col("mode")).alias("message"),
    )
    if payload:
        out = out.join(mode_events(near), ROUTE, "left")
    asked = requests.select("route_id", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    missing = F.col("status").isNull()
    out = asked.join(out, ROUTE, "left")
    told = {"message": F.when(missing, F.concat(F.initcap("mode"), F.lit(" route could not be computed"))).otherwise(F.col("message")), "alerts": F.coalesce("alerts", F.lit(0).cast("long")), "status": F.coalesce("status", F.lit("UNKNOWN"))}
    return out.withColumns(told)


def single_route(requests: DataFrame, events: DataFrame, now: Column, settings: Settings | None = None) -> DataFrame:
    """One row per route along the plain arc, without zones and with the seed (Q1, Q2)."""
    settings = settings or Settings(use_zones=False, drop_seed=False)
    r = cut(base_routes(requests).withColumn("mode", F.lit("direct")))
    risk = agg.route_risk(agg.features(near_events(r, events, settings), now))
    out = r.select("route_id", "mode", F.col("km").alias("route_km")).join(risk, ROUTE, "left")
    return out.fillna({"event_risk": 0.0, "event_count": 0, "dominant_label": "none", "event_band": "LOW"}).drop("mode")
