"""The risk model's columns against the cases it is defined by."""

import math

import pytest
from pyspark.sql import functions as F

from wayrisk.functions import risk as R
from wayrisk.operators import aggregates as agg

def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def ago(seconds):
    return F.timestamp_micros(F.lit(1706659200000000 - int(seconds * 1e6)))


@pytest.mark.parametrize(("age", "low", "high"), [(300, 0.99, 1.0), (86400, 0.49, 0.51), (365 * 86400, 0.01, 0.01), (-3600, 1.0, 1.0)])
def test_recency(spark, age, low, high):
    assert low <= one(spark, R.recency(ago(age), now()))[0] <= high


@pytest.mark.parametrize(("km", "low", "high"), [(0, 1, 1), (50, 0.49, 0.51), (10_000, 0, 0.01), (-1, 1, 1)])
def test_proximity(spark, km, low, high):
    assert low <= one(spark, R.proximity(F.lit(float(km))))[0] <= high


def test_proximity_falls(spark):
    got = [r[0] for r in spark.range(0, 500, 25).select(R.proximity(F.col("id"))).collect()]
    assert got == sorted(got, reverse=True)


def test_composite(spark):
    c = lambda i, r, p: one(spark, R.composite(*map(F.lit, (i, r, p))))[0]
    assert c(0.0, 1.0, 1.0) == 0 and 0.9 < c(1.0, 1.0, 1.0) <= 1 and c(0.5, 0.1, 0.1) < c(0.5, 0.9, 0.1)


@pytest.mark.parametrize(("score", "band"), [(0.10, "LOW"), (0.35, "MEDIUM"), (0.60, "HIGH"), (0.85, "CRITICAL"), (0.25, "MEDIUM"), (0.5, "HIGH"), (0.75, "CRITICAL")])
def test_band(spark, score, band):
    assert one(spark, R.band(F.lit(score)))[0] == band


def risk_of(spark, events):
    rows = [(1, "air", str(i), label, intensity, km) for i, (label, intensity, km) in enumerate(events)]
    df = spark.createDataFrame(rows, "route_id int, mode string, event_id string, label string, intensity_score double, distance_km double").withColumn("published_at", now())
    return agg.route_risk(agg.features(df, now())).collect()


def test_single_conflict(spark):
    r = risk_of(spark, [("conflict", 0.9, 5.0)])[0]
    assert r.event_band == "CRITICAL" and math.isclose(r.event_risk, 0.763485, abs_tol=2e-6)


def test_no_events(spark):
    assert risk_of(spark, []) == []


def test_safe_and_mixed(spark):
    assert risk_of(spark, [("safe", 0.05, 5.0)] * 5)[0].event_risk < 0.2
    assert risk_of(spark, [("conflict", 0.95, 5.0), ("safe", 0.05, 5.0), ("protest", 0.40, 5.0)])[0].dominant_label == "conflict"


@pytest.mark.parametrize("values", [[0.1, 0.5, 0.9, 0.3, 0.7], [0.5, 0.5, 0.5], []])
def test_min_max(spark, values):
    got = [r.y for r in agg.min_max(spark.createDataFrame([(v,) for v in values], "x double"), "x", "y").collect()]
    assert got == ([] if not values else [0.5] * 3 if len(set(values)) == 1 else [0, 0.5, 1, 0.25, 0.75])


def test_combined(spark):
    c = lambda *x: one(spark, R.combined_risk(*map(F.lit, x)))[0]
    assert c(0.5, 0.5, 5, 2, 1) == 0.5 and c(0.0, 0.5, 0, 0, 1) == 0.2 and c(0.5, 0.0, 5, 3, 1) == 0.575 and c(0.5, 0.0, 1, 1, 1) == 0.45


def test_backoff_bounds(spark):
    assert one(spark, R.backoff(F.lit(20), F.lit(1.0)))[0] == 300 and one(spark, R.backoff(F.lit(0), F.lit(-1.0)))[0] == 1.0
