"""Risk aggregates over the events of a route, and the store's reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.functions.risk import band, composite, label_multiplier, proximity, recency, zone_risk
from wayrisk.operators.joins import ROUTE


def features(events: DataFrame, now: Column) -> DataFrame:
    """``events`` (intensity_score, published_at, distance_km) with recency, proximity and composite (M4)."""
    r, p = recency(F.col("published_at"), now), proximity(F.col("distance_km"))
    return events.withColumns({"recency_weight": F.round(r, 6), "proximity_weight": F.round(p, 6), "composite_risk": composite(F.col("intensity_score"), r, p)})


def ranked(events: DataFrame, keys: list[str] = ROUTE) -> DataFrame:
    """With the adjusted score ``adj``, its rank ``rn`` in the group, and the group's size ``n``."""
    e = events.withColumn("adj", F.least(F.col("composite_risk") * label_multiplier(F.col("label")), F.lit(1.0)))
    return e.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("adj"), "event_id"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def trimmed_mean(score: Column, rank: Column, n: Column, share: float = 0.10) -> Column:
    """Mean without the highest and lowest tenth; of fewer than four, of all (A2)."""
    k = F.when(n < 4, 0).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(share))))
    return F.avg(F.when((rank > k) & (rank <= n - k), score))


def dominant_label(ranked_: DataFrame, keys: list[str] = ROUTE) -> DataFrame:
    """keys, dominant_label: the most frequent label of the upper half, the first by name on a tie (A3)."""
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    top = ranked_.where(F.col("rn") <= half).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("c"))
    return top.groupBy(*keys).agg(F.min_by("label", F.struct(-F.col("c"), "label")).alias("dominant_label"))


def route_risk(scored: DataFrame, keys: list[str] = ROUTE) -> DataFrame:
    """keys, event_risk, band, event_count, max and mean scores, dominant label and the five first events (A1)."""
    r = ranked(scored, keys)
    agg = r.groupBy(*keys).agg(
        F.max("adj").alias("max_score"),
        trimmed_mean(F.col("adj"), F.col("rn"), F.col("n")).alias("mean_score"),
        F.max("n").alias("event_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.struct("rn", "event_id")))), lambda x: x["event_id"]), ",").alias("top_events"),
    )
    blend = 0.60 * F.col("max_score") + 0.40 * F.col("mean_score")
    final = F.least(blend * F.when(F.col("event_count") < 3, 0.85).otherwise(1.0), F.lit(1.0))
    agg = agg.join(dominant_label(r, keys), keys)
    return agg.select(*keys, F.round(final, 6).alias("event_risk"), band(final).alias("event_band"), "event_count", F.round("max_score", 6).alias("max_score"), F.round("mean_score", 6).alias("mean_score"), "dominant_label", "top_events")


def zone_totals(hits: DataFrame, keys: list[str] = ROUTE) -> DataFrame:
    """keys, zone_risk, n_zones (A4)."""
    z = hits.where("base_risk > 0").groupBy(*keys).agg(F.max("base_risk").alias("top"), F.count(F.lit(1)).alias("n_zones"))
    return z.select(*keys, F.round(zone_risk(F.col("top"), F.col("n_zones")), 4).alias("zone_risk"), "n_zones")


def corroboration(events: DataFrame, keys: list[str] = ROUTE) -> DataFrame:
    """keys, n_sources, max_corroboration (A5): distinct publishers, or the source where there are none."""
    names = F.when(F.size("publishers") > 0, F.col("publishers")).otherwise(F.array("source"))
    each = events.select(*keys, "corroboration_count", F.explode_outer(names).alias("p"))
    return each.groupBy(*keys).agg(F.count_distinct(F.nullif("p", F.lit(""))).alias("n_sources"), F.greatest(F.lit(1), F.max("corroboration_count")).alias("max_corroboration"))


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scaled to 0 to 1, one half if all are equal (A6): the extremes are one aggregated row, broadcast."""
    ends = F.broadcast(df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi")))
    scaled = F.when(F.col("__lo") == F.col("__hi"), 0.5).otherwise(F.round((F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")), 6))
    return df.join(ends).withColumn(out, scaled).drop("__lo", "__hi")


def source_counts(events: DataFrame) -> DataFrame:
    """Events of each source, most first."""
    return events.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


def diagnostics(events: DataFrame) -> DataFrame:
    """One row of counts by predicate, and the latest event, in one pass."""
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("source") != "seed").alias("non_seed"),
        F.count_if(F.coalesce(F.col("source_url"), F.lit("")) != "").alias("with_url"),
        F.count_if(F.col("schema_version") >= "2").alias("v2"),
        F.count_if(F.col("schema_version") == "5").alias("v5"),
        F.max_by("event_id", F.struct("published_at", "event_id")).alias("latest_event"),
        F.max("published_at").alias("latest_at"),
    )


def timing_stats(timings: DataFrame, last: int = 100) -> DataFrame:
    """(name, count, avg_ms, last_ms, max_ms) of the last ``last`` timings (name, seq, ms) of each name."""
    recent = timings.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("seq")))).where(F.col("r") <= last)
    return recent.groupBy("name").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("ms"), 1).alias("avg_ms"), F.round(F.max_by("ms", "seq"), 1).alias("last_ms"), F.round(F.max("ms"), 1).alias("max_ms"))


def api_latency(log: DataFrame) -> DataFrame:
    """(path, requests, errors, avg_ms, max_ms) of a log of requests (path, status, ms), and a row for all of them with a null path."""
    return log.rollup("path").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), F.round(F.avg("ms"), 2).alias("avg_ms"), F.round(F.max("ms"), 2).alias("max_ms"))


def latest_verified(events: DataFrame, limit: int = 5) -> DataFrame:
    """The last events by time of ingestion that have a credibility score."""
    return events.where("credibility_score is not null").orderBy(F.desc("ingested_at"), "event_id").limit(limit)


def success_rate(log: DataFrame) -> DataFrame:
    """(source, success_rate) of a fetch log."""
    return log.groupBy("source").agg(F.coalesce(F.avg(F.when(F.col("outcome") == "ok", 1.0).otherwise(0.0)), F.lit(1.0)).alias("success_rate"))


def recommended(modes: DataFrame) -> DataFrame:
    """(route_id, recommended_mode): the safest; on a tie air, sea, then road; air without any."""
    order = F.when(F.col("mode") == "air", 0).when(F.col("mode") == "sea", -1).otherwise(-2)
    return modes.groupBy("route_id").agg(F.coalesce(F.max_by("mode", F.when(F.col("safety_score").isNotNull(), F.struct("safety_score", order))), F.lit("air")).alias("recommended_mode"))
