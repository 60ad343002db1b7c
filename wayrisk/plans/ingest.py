"""The ingestion cycle: raw events to incidents, as one chain of columns and one clustering."""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wayrisk.functions import text as T
from wayrisk.functions.python_text import normalize_places, places_udf, unique_places
from wayrisk.functions.risk import contributions, intensity_features, rule_intensity, severe_hits
from wayrisk.operators.clusters import clusters, merge
from wayrisk.operators.cut import cut
from wayrisk.operators.joins import event_zones
from wayrisk.plans import learned
from wayrisk.plans.analysis import geocode
from wayrisk.sources.dimensions import PLACES
from wayrisk.sources.sinks import insert_absent


def annotate(events: DataFrame, text: str = "text", places: list[str] = PLACES, model: PipelineModel | None = None) -> DataFrame:
    """Label, confidence, scores, place names, intensity, its parts and method (L1, M9). Predicates come before the UDF columns.

    With a learned model its probability is the intensity; else the weighted rules are.
    """
    e = events.withColumn("c", T.classify(F.col(text))).withColumn("found", places_udf(places)(F.col(text)))
    e = e.withColumn("location_names", unique_places(F.transform("found", lambda x: x["text"])))
    f = intensity_features(F.col("c.label"), F.col("c.confidence"), F.size("found"), severe_hits(F.col(text)), F.length(text))
    e = e.select("*", F.col("c.label").alias("label"), F.col("c.confidence").alias("label_confidence"), F.col("c.scores").alias("label_scores"), F.round(rule_intensity(f), 4).alias("intensity_score"), contributions(f).alias("intensity_explanation"), F.lit("rule_based").alias("intensity_method"))
    if model is not None:
        e = learned.predict(e.withColumns({k: v.cast("double") for k, v in f.items()}), model, "probability_high").drop(*f)
        e = e.withColumns({"intensity_score": F.round("probability_high", 4), "intensity_method": F.lit("logistic")}).drop("probability_high")
    return e.drop("c", "found")


class Counts:
    """What one run of a cycle counted on its way, without a job of its own.

    Each step's rows are observed as they pass. A count that an executor's loss makes Spark repeat may be too high; the store isn't.
    """

    #: Sources that are counted apart; the others are one.
    SOURCES = ("gdelt", "rss", "newsapi", "gnews", "seed")

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}
        self.errors = 0

    def watch(self, step: str, df: DataFrame, **counts: Column) -> DataFrame:
        self._seen[step] = Observation(step)
        return df.observe(self._seen[step], *(c.alias(k) for k, c in counts.items()))

    def rows(self) -> dict[str, int]:
        """The counts by name; what a step that didn't run would count is 0. Ask once the cycle is written."""
        n = {k: v or 0 for o in self._seen.values() for k, v in o.get.items()}
        of = lambda k: n.get(k, 0)
        steps = {"irrelevant": of("fetched") - of("relevant"), "judged_safe": of("relevant") - of("judged"), "without_place": of("judged") - of("enriched")}
        merged = {"clustered_from": of("enriched"), "clustered_to": of("clustered_to"), "duplicates_merged": max(0, of("enriched") - of("clustered_to"))}
        sources = {k: v for k, v in n.items() if k.startswith("source_") and v}
        return {"fetched": of("fetched"), "enriched": of("enriched"), "written": of("written"), "skipped": sum(steps.values()), "errors": self.errors, **{f"skipped_{k}": v for k, v in steps.items()}, **merged, **sources}

    def table(self, spark: SparkSession) -> DataFrame:
        """(metric, n)."""
        metric, n = zip(*sorted(self.rows().items()))
        # an Arrow table needs no Python workers
        return spark.createDataFrame(pa.table({"metric": pa.array(metric, pa.string()), "n": pa.array(n, pa.int64())}))


def _all() -> Column:
    return F.count(F.lit(1))


def _fetched(e: DataFrame, counts: Counts) -> DataFrame:
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))
    by = {f"source_{x}": F.count_if(source == x) for x in counts.SOURCES}
    other = F.count_if(~source.isin(*counts.SOURCES))
    return counts.watch("fetched", e, fetched=_all(), relevant=F.count("label"), source_other=other, **by)


def _texts(reports: DataFrame) -> DataFrame:
    """Distinct texts, cut: what is asked of a text then is asked once, where Spark would move a filter before the distinct."""
    return cut(reports.select("text").distinct())


def _of_texts(texts: DataFrame, gazetteer: DataFrame, places: list[str], model: PipelineModel | None = None) -> DataFrame:
    """Distinct texts, annotated, with their ``tagged`` place and ``g``, the gazetteer's for those without one."""
    t = cut(annotate(texts.withColumn("tagged", T.geo_tag(F.col("text"))), "text", places, model))
    # the first of up to three normalised names that the gazetteer knows
    names = t.where("tagged is null").select("text", F.posexplode(F.slice(normalize_places("location_names"), 1, 3)).alias("i", "name"))
    known = geocode(names, gazetteer).where("glat is not null").groupBy("text").agg(F.min_by(F.struct("glat", "glon"), "i").alias("g"))
    return cut(t.join(known, "text", "left"))


def _spread(reports: DataFrame) -> DataFrame:
    """Reports dealt evenly to tasks: those that a filter by age leaves often lie in one part of one file."""
    n = int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(reports.repartition(n, "event_id", "source_url", "text"))


def _placed(e: DataFrame, counts: Counts | None = None) -> DataFrame:
    """Annotated events at their coordinates; those without any go."""
    e = e.withColumn("at", T.located(F.col("lat"), F.col("lon"), F.col("tagged"), F.col("g.glat"), F.col("g.glon")))
    if counts:
        e = counts.watch("placed", e, judged=_all(), enriched=F.count("at"))
    return e.where(F.col("at").isNotNull()).withColumns({"lat": F.col("at.lat"), "lon": F.col("at.lon")}).drop("at", "g", "tagged")


def _read(raw: DataFrame, now: Column, gazetteer: DataFrame, places: list[str], model: PipelineModel | None) -> tuple[DataFrame, DataFrame]:
    """Valid events, and the annotated relevant texts among theirs.

    A text is judged, classified and read for places once, however many events have it.
    """
    if "country_code" not in raw.columns:
        raw = raw.withColumn("country_code", F.lit(None).cast("string"))
    valid = _spread(raw.where(T.valid_event(F.col("text"), F.col("source_url"), F.col("published_at"), now)))
    return valid, _of_texts(_texts(valid).where(T.relevant(F.col("text"))), gazetteer, places, model)


def _judged(valid: DataFrame, texts: DataFrame, counts: Counts | None) -> DataFrame:
    """Valid events with what their texts have, if those are relevant, at their coordinates and with their sources' credibility."""
    e = valid.join(texts, "text", "left")
    if counts:
        e = _fetched(e, counts)
    e = _placed(e.where(F.col("label").isNotNull() & T.still_relevant(F.col("label"), F.col("label_confidence"))), counts)
    # columns of their own, as compiled code; a lambda's body is interpreted for each event
    e = e.withColumn("domain", T.domain(F.col("source_url"))).withColumn("base", T.domain_score(F.col("domain")))
    e = e.withColumn("v", T.verified(F.col("domain"), F.col("base"), F.col("publisher")))
    return e.withColumns({"credibility_score": F.col("v.credibility_score"), "credibility_tier": F.col("v.credibility_tier")}).drop("v", "base")


def enrich(raw: DataFrame, now: Column, gazetteer: DataFrame, places: list[str] = PLACES, model: PipelineModel | None = None, counts: Counts | None = None) -> DataFrame:
    """Valid, verified, relevant, annotated, located and zoned events (L2; P1, F12, P2, L1, P3, R10, P6, J2)."""
    return event_zones(_judged(*_read(raw, now, gazetteer, places, model), counts))


#: What an incident takes over from the report that stands for it, besides what merging needs, and from that report's text.
CARRIED, OF_TEXT = ["label_confidence", "country_code", "credibility_tier", "domain"], ["label_scores", "location_names", "intensity_explanation", "intensity_method"]


def _ranked(reports: DataFrame) -> DataFrame:
    """Reports with ``ord``, a number in the order of source and id."""
    n = int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["source", "event_id", "published_at", "source_url", "raw_text", "lat", "lon", "publisher", "image_url"]
    return cut(reports.repartitionByRange(n, "source", "event_id").sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id()))


def incidents(enriched: DataFrame, texts: DataFrame, now: Column, counts: Counts | None = None) -> DataFrame:
    """Enriched events of one cycle as incidents with all stored fields; by source and id, the first report heads an incident.

    An incident has its longest report's text, place, label, scores, explanation, place names, country, tier and domain; ``retrieved_at`` and
    ``ingested_at`` are the cycle's time. ``texts`` has the columns that follow from a text alone; clustering goes without them.
    """
    e = cut(enriched.select("event_id", F.col("text").alias("raw_text"), "label", "lat", "lon", "published_at", "publisher", "source_url", "image_url", "source", "intensity_score", "credibility_score", *CARRIED))
    found = merge(cut(clusters(_ranked(e).drop("event_id"))), CARRIED)
    out = event_zones(found.join(texts.select(F.col("text").alias("raw_text"), *OF_TEXT), "raw_text"))
    if counts:
        out = counts.watch("clustered", out, clustered_to=_all())
    stored = {"event_id": F.col("canonical_event_id"), "published_at": F.col("latest_source_at"), "ingested_at": now, "retrieved_at": now, "classification_method": F.lit("heuristic"), "ner_method": F.lit("regex"), "schema_version": F.lit("5")}
    return out.withColumns(stored).drop("cluster")


def cycle(raw: DataFrame, now: Column, gazetteer: DataFrame, places: list[str] = PLACES, model: PipelineModel | None = None, counts: Counts | None = None) -> DataFrame:
    """Incidents of one cycle of raw events, ready to be stored (Q6, T2); ``counts`` takes down what each step passed on."""
    valid, texts = _read(raw, now, gazetteer, places, model)
    return incidents(_judged(valid, texts.drop(*OF_TEXT), counts), texts, now, counts)


def store_cycle(raw: DataFrame, store: str, now: Column, gazetteer: DataFrame, metrics: str | None = None) -> Counts:
    """Run one cycle into the store and give its counts; with ``metrics``, append them there as (at, metric, n).

    If the write fails, the incidents that weren't written count as errors and the failure goes on.
    """
    counts = Counts()
    found = cut(cycle(raw, now, gazetteer, counts=counts))
    try:
        insert_absent(found, store, watch=lambda rows: counts.watch("written", rows, written=_all()))
    except Exception:
        counts._seen.pop("written", None)
        counts.errors = counts.rows()["clustered_to"]
        raise
    finally:
        if metrics:
            counts.table(raw.sparkSession).select(now.alias("at"), "metric", "n").write.mode("append").parquet(metrics)
    return counts


def legacy_cycle(raw: DataFrame, now: Column, gazetteer: DataFrame, places: list[str] = PLACES) -> DataFrame:
    """The older cycle over one feed (K2): valid events are annotated and located, but neither filtered by relevance nor clustered."""
    valid = _spread(raw.where(T.valid_event(F.col("text"), F.col("source_url"), F.col("published_at"), now)))
    e = _placed(valid.join(_of_texts(_texts(valid), gazetteer, places), "text"))
    return e.withColumns({"ingested_at": now, "schema_version": F.lit("2")}).withColumnRenamed("text", "raw_text")


def cycle_stats(fetched: DataFrame, enriched: DataFrame, merged: DataFrame) -> DataFrame:
    """(metric, n): how many events each step of a cycle passed on, and how many came from each source.

    ``fetched`` and ``enriched`` have a source; ``merged`` has a row for each incident.
    """
    source = F.coalesce("source", F.lit("unknown"))
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
    three = total(fetched, "fetched").union(total(enriched, "enriched")).union(total(merged, "written"))
    one = three.agg(*(F.max(F.when(F.col("metric") == m, F.col("n"))).alias(m) for m in ("fetched", "enriched", "written")))
    derived = F.map_from_arrays(
        F.array(*map(F.lit, ("fetched", "enriched", "skipped", "written", "clustered_from", "clustered_to", "duplicates_merged"))),
        F.array(F.col("fetched"), F.col("enriched"), F.col("fetched") - F.col("enriched"), F.col("written"), F.col("enriched"), F.col("written"), F.greatest(F.lit(0), F.col("enriched") - F.col("written"))),
    )
    by_source = fetched.groupBy(F.concat(F.lit("source_"), source).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return one.select(F.explode(derived).alias("metric", "n")).union(by_source)
