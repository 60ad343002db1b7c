"""One command from feeds to an answer: purge, refresh, diagnose, analyse (Q8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayrisk.operators.aggregates import diagnostics
from wayrisk.plans.analysis import Settings, multi_mode, store_path
from wayrisk.plans.ingest import store_cycle
from wayrisk.sources.feeds import fan_in
from wayrisk.sources.sinks import purge
from wayrisk.streaming.ingest import needs_fetch


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """The store's incidents with the columns that analyses read."""
    e = spark.read.parquet(path)
    return e.withColumns({"ord": F.col("event_id"), "publisher": F.coalesce(F.get("publishers", F.lit(0)), F.lit("")), "source_url": F.coalesce(F.get("source_urls", F.lit(0)), F.lit(""))})


def live_run(spark: SparkSession, path: str, requests: DataFrame, fetch: Callable[[], list[DataFrame]], now: Column, gazetteer: DataFrame, cycles: int = 3, settings: Settings | None = None) -> tuple[int, DataFrame, DataFrame]:
    """(seed events purged, diagnostics of the store, risk of each route and mode).

    While the store lacks fresh events, ``fetch`` gives the raw events of each source and a cycle stores them, at most ``cycles`` times.
    """
    store_path(path)
    purged = purge(spark, path)
    for _ in range(cycles):
        if not needs_fetch(spark, path, now):
            break
        store_cycle(fan_in(fetch()), path, now, gazetteer)
    events = stored_events(spark, path)
    return purged, diagnostics(events), multi_mode(requests, events, now, settings=settings)
