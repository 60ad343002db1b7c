"""Column expressions of the risk model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayrisk.sources.dimensions import CATEGORY_FACTOR, FEATURE_WEIGHTS, LABEL_MULTIPLIER, LABEL_SEVERITY, SEVERE_KEYWORDS


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def label_multiplier(label: Column) -> Column:
    return _lookup(LABEL_MULTIPLIER, label, 0.5)


def label_severity(label: Column) -> Column:
    return _lookup(LABEL_SEVERITY, label, 0.3)


def zone_factor(category: Column) -> Column:
    return _lookup(CATEGORY_FACTOR, category, 1.0)


def recency(published: Column, now: Column, half_life_days: float = 1.0, floor: float = 0.01) -> Column:
    """2 ** -(age in half-lives), at least ``floor``; the future counts as now (M1)."""
    us = F.greatest(F.unix_micros(now) - F.unix_micros(published), F.lit(0))
    return F.greatest(F.pow(F.lit(2.0), -us / (half_life_days * 86400e6)), F.lit(floor))


def proximity(km: Column, half_km: float = 50.0) -> Column:
    """1 at the route, one half at ``half_km`` (M2)."""
    return F.when(km <= 0, 1.0).otherwise(1 / (1 + F.pow(km / half_km, 2)))


def composite(intensity: Column, recent: Column, near: Column) -> Column:
    """Intensity weighted by recency and proximity (M3)."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), intensity * (0.5 + 0.3 * recent + 0.2 * near))), 6)


def band(score: Column) -> Column:
    """LOW, MEDIUM, HIGH or CRITICAL (M5)."""
    return F.when(score < 0.25, "LOW").when(score < 0.5, "MEDIUM").when(score < 0.75, "HIGH").otherwise("CRITICAL")


def zone_risk(highest: Column, n: Column) -> Column:
    """Highest base risk, raised for each further zone (A4)."""
    return F.when(n > 0, F.least(highest + F.least(F.lit(0.20), (n - 1) * 0.05), F.lit(0.95))).otherwise(0.0)


def combined_risk(event_risk: Column, zone: Column, n_events: Column, n_sources: Column, corroborated: Column) -> Column:
    """Risk of events and zones, raised if corroborated, lowered if thin (M6)."""
    base = F.when((event_risk > 0) & (zone > 0), event_risk * 0.70 + zone * 0.30).when(event_risk > 0, event_risk).when(zone > 0, zone * 0.40).otherwise(0.0)
    strong = (n_sources >= 3) | (corroborated >= 3)
    raised = F.when(strong, F.least(base * 1.15, F.lit(1.0))).when((n_sources <= 1) & (n_events <= 2), base * 0.90).otherwise(base)
    return F.round(F.least(F.when(n_events > 0, raised).otherwise(base), F.lit(1.0)), 4)


def message(alerts: Column, risk: Column, mode: Column) -> Column:
    """A sentence on a mode's risk."""
    name, n = F.initcap(mode), alerts.cast("string")
    return (
        F.when((risk < 0.25) & (alerts == 0), F.concat(F.lit("No significant geopolitical risk along "), name, F.lit(" route")))
        .when(risk < 0.25, F.concat(F.lit("Minor events detected near "), name, F.lit(" corridor — route considered safe")))
        .when(risk < 0.5, F.concat(F.lit("Moderate geopolitical risk on "), name, F.lit(" route — "), F.when(alerts > 0, F.concat(n, F.lit(" event(s) detected"))).otherwise("active risk zones on route")))
        .when(risk < 0.75, F.concat(F.lit("High-risk "), name, F.lit(" route — "), F.when(alerts > 0, F.concat(F.lit("conflict zones and "), n, F.lit(" event(s) nearby"))).otherwise("route passes through active conflict/choke point zones")))
        .otherwise(F.concat(F.lit("Critical risk on "), name, F.lit(" route — "), F.when(alerts > 0, F.concat(F.lit("significant conflict activity ("), n, F.lit(" event(s))"))).otherwise("multiple high-danger zones on route")))
    )


def severe_hits(text: Column) -> Column:
    """Distinct severe keywords in a text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(k)).cast("int") for k in SEVERE_KEYWORDS), F.lit(0))


def intensity_features(label: Column, confidence: Column, n_places: Column, hits: Column, length: Column) -> dict[str, Column]:
    """The six inputs of the intensity score (M7)."""
    severity = label_severity(label)
    return {
        "label_severity": severity,
        "classifier_confidence": confidence,
        "ner_density": F.least(n_places / F.greatest(F.sqrt(length + 1), F.lit(1.0)), F.lit(1.0)),
        "keyword_intensity": F.least(hits / len(SEVERE_KEYWORDS), F.lit(1.0)),
        "text_richness": F.least(F.log(length + 1.0) / 10, F.lit(1.0)),
        "composite": severity * confidence,
    }


def rule_intensity(features: dict[str, Column]) -> Column:
    """The weighted sum of the features (M8)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((features[k] * w for k, w in FEATURE_WEIGHTS.items()), F.lit(0.0))))


def contributions(features: dict[str, Column]) -> Column:
    return F.create_map(*(x for k, w in FEATURE_WEIGHTS.items() for x in (F.lit(k), features[k] * w)))


def backoff(attempt: Column, unit: Column, base: float = 2.0, most: float = 300.0, jitter: float = 0.5) -> Column:
    """Seconds to wait; ``unit`` is uniform in [-1, 1]."""
    return F.greatest(F.lit(0.5), F.least(base * F.pow(F.lit(2.0), attempt) * (1 + jitter * unit), F.lit(most)))
