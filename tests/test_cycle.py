"""A whole ingestion cycle: every stored column and every count, held against its steps taken one by one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayrisk.functions import text as T
from wayrisk.plans import ingest
from wayrisk.plans.analysis import place_names
from wayrisk.sources import feeds
from wayrisk.sources.dimensions import gazetteer

AT = dt.datetime(2024, 1, 31)
DAY = dt.datetime(2024, 1, 30, 6)
SHIP = "Houthi drone strike damages cargo ship in the Red Sea"
RAW = [
    ("a1", SHIP, "rss", "https://www.reuters.com/1", "Reuters", None, "YE", DAY, None, None),
    ("a2", SHIP + " as tankers turn away", "gdelt", "https://example.org/2", "Harbor Post", "http://img/2", "EG", DAY + dt.timedelta(hours=3), None, None),
    ("a3", SHIP, "newsapi", "https://example.org/2", "", "http://img/3", None, DAY - dt.timedelta(hours=2), None, None),
    ("b1", "Earthquake and tsunami warning issued for the coast", "rss", "https://bbc.co.uk/q", "BBC News", None, None, DAY, 35.0, 139.0),
    ("b2", "Troops clash with rebels near Khartoum, many killed", "odd", "", "", None, None, DAY, 95.0, 10.0),
    ("c1", "Premier league match result surprises the fans again", "rss", "https://x.org/s", "", None, None, DAY, 1.0, 1.0),
    ("c2", "too short", "rss", "https://x.org/t", "", None, None, DAY, 1.0, 1.0),
    ("c3", SHIP, "rss", "https://x.org/old", "", None, None, DAY - dt.timedelta(days=9), None, None),
    ("c4", "Missile strike kills soldiers somewhere without a name", "gnews", "https://x.org/n", "", None, None, DAY, None, None),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, feeds.RAW_EVENT).repartition(3)


def now():
    return F.lit(AT)


def test_every_column(spark, raw):
    e = {r.event_id: r for r in ingest.enrich(raw, now(), gazetteer(spark)).collect()}
    assert set(e) == {"a1", "a2", "a3", "b1", "b2"} and e["b1"].lat == 35.0 and -90 <= e["b2"].lat <= 90
    alone = {r.event_id: r for r in ingest.annotate(raw).withColumn("v", T.verify(F.col("source_url"), F.col("publisher"))).collect()}
    got = {r.cluster_size: r for r in ingest.cycle(raw, now(), gazetteer(spark)).where("label = 'conflict' or cluster_size = 3 or raw_text like 'Earth%'").collect()}
    every = ingest.cycle(raw, now(), gazetteer(spark)).collect()
    assert sorted(r.cluster_size for r in every) == [1, 1, 3]
    for r in every:
        base = "a2" if r.cluster_size == 3 else "b1" if r.raw_text.startswith("Earth") else "b2"
        own, text = alone[base], next(x[1] for x in RAW if x[0] == base)
        carried = (r.raw_text, r.label, r.label_confidence, r.label_scores, r.location_names, r.intensity_explanation, r.intensity_method, r.country_code)
        assert carried == (text, own.label, own.label_confidence, own.label_scores, own.location_names, own.intensity_explanation, "rule_based", own.country_code)
        assert (r.credibility_tier, r.domain, r.lat, r.lon) == (own.v.credibility_tier, own.v.domain, e[base].lat, e[base].lon)
        assert (r.schema_version, r.classification_method, r.ner_method, r.ingested_at, r.retrieved_at) == ("5", "heuristic", "regex", AT, AT)
        assert r.event_id == r.canonical_event_id and r.published_at == r.latest_source_at and r.zones == e[base].zones and r.source == own.source
    ship = got[3]
    of = [alone[k] for k in ("a1", "a2", "a3")]
    assert ship.published_at == DAY + dt.timedelta(hours=3) and ship.image_url == "http://img/2" and ship.country_code == "EG"
    # by source and id: gdelt, newsapi, rss
    assert ship.publishers == ["Harbor Post", "Reuters"] and ship.source_urls == ["https://example.org/2", "https://www.reuters.com/1"] and ship.corroboration_count == 2
    assert ship.intensity_score == round(sum(r.intensity_score for r in of) / 3, 4) and ship.representative_headline == RAW[1][1]
    assert ship.combined_credibility == pytest.approx(sum(r.v.credibility_score for r in of) / 3, abs=1e-4)


def test_counts_of_the_run(spark, raw, tmp_path):
    store, metrics = str(tmp_path / "store"), str(tmp_path / "metrics")
    got = ingest.store_cycle(raw, store, now(), gazetteer(spark), metrics).rows()
    want = {"fetched": 7, "enriched": 5, "written": 3, "errors": 0, "skipped": 2, "skipped_irrelevant": 1, "skipped_judged_safe": 0, "skipped_without_place": 1}
    want |= {"clustered_from": 5, "clustered_to": 3, "duplicates_merged": 2, "source_rss": 3, "source_gdelt": 1, "source_newsapi": 1, "source_gnews": 1, "source_other": 1}
    assert got == want
    again = ingest.store_cycle(raw, store, now(), gazetteer(spark), metrics).rows()
    assert again == want | {"written": 0}
    stored = spark.read.parquet(metrics)
    assert stored.count() == 2 * len(want) and stored.where("metric = 'written'").agg(F.sum("n")).first()[0] == 3
    # what was stored answers for place names
    named = place_names(spark.read.parquet(store).withColumns({"ord": F.col("event_id"), "route_id": F.lit(1), "mode": F.lit("sea")})).first().locations
    assert "Red Sea" in named


def test_failed_write_counts_errors(spark, raw, tmp_path):
    bad, metrics = str(tmp_path / "file"), str(tmp_path / "m")
    (tmp_path / "file").write_text("no store")
    with pytest.raises(Exception):  # noqa: B017
        ingest.store_cycle(raw, bad, now(), gazetteer(spark), metrics)
    assert {r.metric: r.n for r in spark.read.parquet(metrics).collect()}["errors"] == 3


def test_nothing_fetched(spark, raw, tmp_path):
    got = ingest.store_cycle(raw.limit(0), str(tmp_path / "s"), now(), gazetteer(spark)).rows()
    assert not any(got.values())


def test_many_reports_of_a_text(spark, monkeypatch):
    """Copies of a text at one place become incidents without being paired; every one is counted."""
    from wayrisk.operators import clusters as module

    rows = [(f"k{i:04}", SHIP, "rss", f"https://example.org/{i}", "Reuters", None, None, DAY + dt.timedelta(seconds=i), None, None) for i in range(300)]
    sizes, keep, counts = [], module.cut, ingest.Counts()

    def counted(df):
        out = keep(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(module, "cut", counted)
    got = ingest.cycle(spark.createDataFrame(rows, feeds.RAW_EVENT), now(), gazetteer(spark), counts=counts).collect()
    assert [r.cluster_size for r in got] == [300] and max(sizes) <= 300
    assert (counts.rows()["clustered_from"], counts.rows()["clustered_to"]) == (300, 1)


def test_texts_are_read_once(spark, monkeypatch):
    """However many events have a text, it is annotated once; events that lie in one part of the input are dealt to several tasks."""
    texts = [SHIP, RAW[3][1], "Troops clash with rebels near Khartoum", "Missile strike kills soldiers somewhere without a name", "Premier league match result surprises the fans again"]
    rows = [(f"k{i % 90:04}", texts[i % 5], "rss", f"https://example.org/{i}", "Reuters", None, None, DAY + dt.timedelta(seconds=i), None, None) for i in range(400)]
    read, parts, annotate, keep, counts = [], [], ingest.annotate, ingest.cut, ingest.Counts()

    def read_by(events, *args):
        read.append(events.count())
        return annotate(events, *args)

    def counted(df):
        out = keep(df)
        parts.append(max((r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()), default=0))
        return out

    monkeypatch.setattr(ingest, "annotate", read_by)
    monkeypatch.setattr(ingest, "cut", counted)
    e = ingest.enrich(spark.createDataFrame(rows, feeds.RAW_EVENT).coalesce(1), now(), gazetteer(spark), counts=counts).cache()
    assert e.count() == 160 and read == [4] and max(parts) < 400
    # ids that several texts share don't mix their places
    assert sorted(r.text for r in e.select("text", "lat", "lon").distinct().collect()) == sorted([texts[0], texts[2]])
    got = counts.rows()
    assert (got["fetched"], got["skipped_irrelevant"], got["skipped_without_place"], got["source_rss"]) == (400, 80, 160, 400)


def test_counts_of_tables(spark, monkeypatch):
    """The query's cycle reads each text once, and its counts are those of all events that have it."""
    from wayrisk.plans import domain
    from wayrisk.plans.queries import QUERIES

    path, read, annotate = "/root/testdata/sf0.001", [], ingest.annotate

    def read_by(events, *args):
        read.append(events.count())
        return annotate(events, *args)

    monkeypatch.setattr(ingest, "annotate", read_by)
    got = {r.metric: r.n for r in QUERIES["cycle_counts"](spark, path).collect()}
    valid = domain.events(spark, path).where(T.valid_event(F.col("raw_text"), F.col("source_url"), F.col("published_at"), domain.now()))
    relevant = valid.where(T.relevant(F.col("raw_text")))
    assert read == [relevant.select("raw_text").distinct().count()] and 0 < read[0] < relevant.count()
    assert (got["fetched"], got["skipped_irrelevant"], got["source_rss"]) == (valid.count(), valid.count() - relevant.count(), valid.where("source = 'rss'").count())
    assert got["enriched"] == got["clustered_from"] == got["clustered_to"] + got["duplicates_merged"] > 0


def test_relevance_is_asked_once_for_a_text(spark, monkeypatch):
    """Spark moves a filter before a distinct; a text's relevance must not be asked for every event that has it."""
    rows = [(f"k{i:04}", RAW[0 if i % 2 else 3][1], "rss", f"https://example.org/{i}", "Reuters", None, None, DAY, 1.0, 2.0) for i in range(400)]
    asked = spark.sparkContext.accumulator(0)

    def may_matter(text):
        asked.add(1)
        return True

    monkeypatch.setattr(ingest.T, "relevant", lambda text: F.udf(may_matter, "boolean")(text))
    assert ingest.enrich(spark.createDataFrame(rows, feeds.RAW_EVENT), now(), gazetteer(spark)).count() == 400
    assert asked.value == 2


def test_pairs_of_kinds_on_near_days(spark):
    """A kind with many days is sought by spans of days, not for each of them; pairs are those of the same day or the next, before 1970 too."""
    from wayrisk.operators.clusters import _DAY, candidates, kinds_of, reports_of

    days_of = {0: [-9], 1: [-8, 3], 2: [-5, -4], 3: [-3], 4: [-1], 5: [0, 7, 8], 6: [1], 7: [4, 5], 8: [6], 9: [12], 10: list(range(-40, -20)), 11: [-20]}
    rows = [(i * 100 + k, f"report number {i} of it", "conflict", 10.0, 20.0, d * _DAY) for i, ds in days_of.items() for k, d in enumerate(ds)]
    docs = spark.createDataFrame(rows, "ord long, raw_text string, label string, lat double, lon double, t long").withColumn("published_at", F.timestamp_micros("t"))
    kinds = kinds_of(docs)
    of = {r.kind: int(r.text.split()[2]) for r in kinds.collect()}
    pairs = candidates(kinds, reports_of(docs, kinds).select("kind", "day").distinct())
    got = sorted(tuple(sorted((of[r.a], of[r.b]))) for r in pairs.collect())
    assert got == [(a, b) for a in days_of for b in days_of if a < b and any(abs(x - y) <= 1 for x in days_of[a] for y in days_of[b])]


def test_heads_of_texts_stand_for_urls(spark):
    """An incident's id comes from its urls, or from its texts' beginnings where no report has a url."""
    import hashlib

    from wayrisk.operators.clusters import merge

    rows = [(0, 0, "Zulu text", "", ""), (1, 0, "alpha TEXT", None, ""), (2, 0, "Zulu text", "", "Post"), (3, 3, "Some text", "", ""), (4, 3, "Some text", "https://x.org/b", ""), (5, 3, "Some text", "https://x.org/a", "")]
    docs = spark.createDataFrame(rows, "ord long, cluster long, raw_text string, source_url string, publisher string")
    docs = docs.withColumns({"label": F.lit("safe"), "lat": F.lit(1.0), "lon": F.lit(1.0), "image_url": F.lit(None).cast("string"), "source": F.lit("rss"), "published_at": F.lit(DAY), "intensity_score": F.lit(0.5), "credibility_score": F.lit(0.5)})
    got = {r.cluster: r for r in merge(docs).collect()}
    of = lambda x: "incident-" + hashlib.sha1(x.encode()).hexdigest()[:16]
    assert got[0].canonical_event_id == of("alpha text|zulu text") and got[0].publishers == ["Post"] and got[0].source_urls == []
    assert got[3].canonical_event_id == of("https://x.org/a|https://x.org/b") and got[3].source_urls == ["https://x.org/b", "https://x.org/a"]
