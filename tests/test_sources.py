"""Landed feeds, the store, streams and state machines."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from wayrisk.operators import state
from wayrisk.sources import dimensions, feeds, sinks
from wayrisk.streaming.ingest import ingest, landed, needs_fetch
from wayrisk.streaming.state import load_states, save_states, track


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def test_gdelt(spark, tmp_path):
    articles = [{"url": "http://a/1", "title": "A title that is long enough", "seendate": "20240130T101500Z", "domain": "a"}, {"url": "http://a/2", "title": "short"}, {"url": "http://a/3", "title": "Another title that is long", "seendate": "bad"}]
    (tmp_path / "x.json").write_text(json.dumps({"articles": articles}))
    got = feeds.gdelt(spark, str(tmp_path), now()).orderBy("source_url").collect()
    assert [r.published_at for r in got] == [dt.datetime(2024, 1, 30, 10, 15), dt.datetime(2024, 1, 31)] and got[0].event_id.startswith("gdelt-")


def test_rss_and_news(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><item><title><![CDATA[One]]></title><link>http://x/1</link><description>About <b>one</b></description></item><item><title>One again</title><link>http://x/1</link></item><item></item></rss>")
    got = feeds.rss(spark, str(tmp_path / "feed.xml"), now()).collect()
    assert [(r.text, r.publisher) for r in got] == [("One. About one", "feed")]
    (tmp_path / "n.json").write_text(json.dumps({"articles": [{"url": "http://n/1", "title": "T", "description": "D", "source": {"name": "N"}}]}))
    got = feeds.news(spark, str(tmp_path / "n.json"), "newsapi", now(), 25).first()
    assert (got.text, got.publisher, got.source) == ("T. D", "N", "newsapi")


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    a = spark.createDataFrame([("1", "a"), ("1", "b")], "event_id string, source string").withColumn("ingested_at", now())
    sinks.insert_absent(a, path)
    sinks.insert_absent(spark.createDataFrame([("1", "c"), ("2", "seed")], "event_id string, source string").withColumn("ingested_at", now()), path)
    got = feeds.store(spark, path)
    assert got.count() == 2 and sinks.without_source(got).count() == 1 and sinks.live(got, now()).count() == 2
    assert sinks.from_document(sinks.to_document(got)).columns == got.columns and needs_fetch(spark, path, now()) and needs_fetch(spark, path + "-none", now())


def log(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("gnews", base + dt.timedelta(seconds=s), i, o) for i, (s, o) in enumerate(rows)], "source string, ts timestamp, seq long, outcome string")


def test_state_machines(spark):
    rows = [(0, "fail"), (10, "fail"), (20, "fail"), (30, "429"), (40, "429"), (50, "ok"), (60, "ok")]
    got = state.replay(log(spark, rows)).orderBy("ts").collect()
    base = got[0].ts
    assert [r.failures for r in got] == [1, 2, 3, 4, 5, 0, 0]
    assert [r.allowed for r in got] == [True, True, True, False, False, False, False]
    assert got[2].cooldown_until - base == 20 + 480 and got[4].suppressions == 1 and got[5].suppressed and not got[4].suppressed and got[4].limited


def test_windows(spark):
    rows = [(0, "ok"), (86399, "fail"), (86400, "fail"), (86401, "ok")]
    got = state.rolling_requests(log(spark, rows)).orderBy("seq").collect()
    assert [r.used for r in got] == [1, 2, 2, 3]
    assert [r.run for r in state.failure_runs(log(spark, rows)).orderBy("seq").collect()] == [0, 1, 2, 0]


def raw_rows(n):
    return [(f"e{i}", "Houthi drone strike damages cargo ship in the Red Sea", "rss", f"http://x/{i}", f"p{i}", None, None, dt.datetime(2024, 1, 30), None, None) for i in range(n)]


def test_streams(spark, tmp_path):
    """Whole cycles over a stream: an event that comes twice counts once, also in a later batch, and incidents are stored once."""
    path = lambda x: str(tmp_path / x)
    spark.createDataFrame(raw_rows(3) + raw_rows(1), feeds.RAW_EVENT).write.parquet(path("in"))
    run = lambda: ingest(landed(spark, path("in")), path("store"), path("c"), once=True, now=now()).awaitTermination()
    run()
    got = spark.read.parquet(path("store")).collect()
    assert len(got) == 1 and got[0].corroboration_count == 3 and "Red Sea / Bab el-Mandeb" in got[0].zones
    spark.createDataFrame(raw_rows(2), feeds.RAW_EVENT).write.mode("append").parquet(path("in"))
    run()
    assert spark.read.parquet(path("store")).count() == 1
    log(spark, [(0, "fail"), (10, "fail"), (20, "fail"), (30, "ok")]).write.parquet(str(tmp_path / "log"))
    stream = track(spark.readStream.schema("source string, ts timestamp, seq long, outcome string").parquet(str(tmp_path / "log")))
    q = stream.writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.failures for r in spark.table("tracked").orderBy("ts").collect()] == [1, 2, 3, 0]


def test_fixed_tables():
    assert len(dimensions.keyword_rows()) == 201 and len(dimensions.GEO_TAGS) == 28 and [len(dimensions.TIERS[t]) for t in dimensions.TIERS] == [16, 23, 11]


@pytest.mark.parametrize("bad", [dict(radius_km=0), dict(min_confidence=2), dict(results=0)])
def test_settings(bad):
    from wayrisk.plans.analysis import Settings, location

    with pytest.raises(ValueError):
        Settings(**bad)
    with pytest.raises(ValueError):
        location(" x ")


def test_settings_from_environment():
    from wayrisk.plans.analysis import Settings, store_path

    assert Settings.from_env({"ROUTE_BUFFER_KM": "80", "OTHER": "x"}, results=5) == Settings(radius_km=80.0, results=5)
    for env in ({"ROUTE_BUFFER_KM": "far"}, {"MIN_LABEL_CONFIDENCE": "1.5"}):
        with pytest.raises(ValueError):
            Settings.from_env(env)
    assert store_path("hdfs://host/x") == "hdfs://host/x" and store_path("/data/store")
    for bad in (None, " ", "s3://<cluster>/x", "://x"):
        with pytest.raises(ValueError):
            store_path(bad)


def test_gnews(spark, tmp_path):
    many = [{"url": f"http://g/{i}", "title": f"T{i}", "image": "http://i", "source": {"name": "G"}} for i in range(14)]
    (tmp_path / "g.json").write_text(json.dumps({"articles": many}))
    got = feeds.news(spark, str(tmp_path / "g.json"), "gnews", now(), 25).collect()
    assert len(got) == 10 and {r.image_url for r in got} == {"http://i"} and all(r.event_id.startswith("gnews-") for r in got)
    both = feeds.fan_in([feeds.news(spark, str(tmp_path / "g.json"), "gnews", now(), 25)] * 2, most=4)
    assert both.count() == 4


def test_rotation(spark):
    got = [r.q for r in spark.range(9).select(feeds.rotated_query(F.col("id")).alias("q")).collect()]
    assert len(set(got)) == 8 and got[8] == got[0] == "conflict war military" and got[7] == "border dispute territorial"


def test_purge(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("1", "seed", "2024-01-30"), ("2", "rss", "2024-01-30"), ("3", "seed", "2024-01-29"), ("4", "rss", "2024-01-28")]
    df = spark.createDataFrame(rows, "event_id string, source string, day string").withColumn("ingested_at", F.col("day").cast("timestamp"))
    sinks.insert_absent(df, path)
    assert sinks.purge(spark, path) == 2 and sinks.purge(spark, path) == 0 and sinks.purge(spark, path + "-none") == 0
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == ["2", "4"] and [p.name for p in tmp_path.iterdir()] == ["store"]


def test_wait(spark, tmp_path):
    pauses = []
    sinks.wait_for(spark, str(tmp_path), sleep=pauses.append)
    assert not pauses
    with pytest.raises(Exception, match="nosuch"):
        sinks.wait_for(spark, "nosuch://x/y", tries=3, sleep=pauses.append)
    assert pauses == [2.0, 4.0]


def test_states_as_folded(spark):
    """Sources in order, one of them without a quota, as attempts folded one by one; no source is a group of one Python task."""
    rng, base = random.Random(3), dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    at = sorted(rng.choice([60, 700, 1801]) * rng.randint(0, 250) for _ in range(500))
    rows = [(rng.choice(["rss", "gnews", "other"]), base + dt.timedelta(seconds=t), i, rng.choice(["ok", "fail", "fail", "429", "429", "exhausted"])) for i, t in enumerate(at)]
    sources = {n: state.Source(n) for n in ("rss", "gnews", "other")}
    want = sorted(sources[n].take(t.timestamp(), o) for n, t, _, o in rows)
    got = state.states(spark.createDataFrame(rows, "source string, ts timestamp, seq long, outcome string")).select(*state.SHOWN)
    assert sorted(map(tuple, got.collect())) == want and len({w[7] for w in want}) > 3
    assert "InPandas" not in got._jdf.queryExecution().toString()


def test_rolling_requests_of_many(spark):
    """Counts by brute force, with equal times and none; no window's frame slides over a source's rows."""
    rng, base = random.Random(9), dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["rss", "gnews", None]), base + dt.timedelta(seconds=rng.choice([3600, 1800, 7]) * rng.randint(0, 90)) if rng.random() > 0.05 else None, i) for i in range(400)]
    got = state.rolling_requests(spark.createDataFrame(rows, "source string, ts timestamp, seq long"))
    inside = lambda a, b: a[0] == b[0] and (a[1] is b[1] if None in (a[1], b[1]) else dt.timedelta(0) <= b[1] - a[1] < dt.timedelta(days=1))
    assert {r.seq: r.used for r in got.collect()} == {b[2]: sum(inside(a, b) for a in rows) for b in rows}
    assert got.columns == ["source", "ts", "seq", "used"] and "86399999999" not in got._jdf.queryExecution().toString()


def test_states_file(spark, tmp_path):
    states = state.replay(log(spark, [(0, "ok"), (2000, "fail"), (4000, "ok")]))
    save_states(states, str(tmp_path / "s"))
    got = load_states(spark, str(tmp_path / "s")).collect()
    assert [(r.source, r.used, r.failures, r.daily_limit, r.remaining) for r in got] == [("gnews", 2, 0, 90, 88)]


def test_states_restart(spark, tmp_path):
    """A stream that starts anew from a saved file goes on as if it had never stopped, over several batches; other sources stay saved."""
    rng = random.Random(8)
    rows, at = [], 0
    for _ in range(300):
        at += rng.choice([1, 60, 700, 1801, 4000])
        rows.append((at, rng.choice(["ok", "ok", "fail", "fail", "fail", "429", "exhausted"])))
    whole = log(spark, rows)
    schema, half = "source string, ts timestamp, seq long, outcome string", 150
    old = log(spark, [(5, "ok")]).withColumn("source", F.lit("rss"))
    whole.where(F.col("seq") < half).union(old).write.parquet(str(tmp_path / "a"))
    for k, (start, end) in enumerate(((half, 200), (200, 300))):
        whole.where(F.col("seq").between(start, end - 1)).coalesce(1).write.parquet(str(tmp_path / f"b/part={k}"))

    def run(name, path, saved=None):
        stream = track(spark.readStream.schema(schema).option("maxFilesPerTrigger", 100 if saved is None else 1).parquet(path), saved)
        stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    save_states(run("before", str(tmp_path / "a")), str(tmp_path / "s"))
    saved = load_states(spark, str(tmp_path / "s"))
    after = run("after", str(tmp_path / "b" / "*"), saved)
    keys = ["ts", "allowed", "used", "failures", "cooldown_until", "suppressed", "suppressions", "limited"]
    of = lambda df: [tuple(r) for r in df.select(*keys).orderBy("ts").collect()]
    want = of(state.replay(whole))
    assert of(after) == want[half:] and len({r[5] for r in want[half:]}) == 2 and of(after) != of(state.replay(whole.where(F.col("seq") >= half)))
    assert of(state.replay(whole.where(F.col("seq") >= half), saved)) == want[half:]
    save_states(after, str(tmp_path / "t"), saved)
    assert [(r.source, r.used) for r in load_states(spark, str(tmp_path / "t")).orderBy("source").collect()] == [("gnews", want[-1][2]), ("rss", 1)]


def test_json_lines():
    import logging

    from wayrisk.streaming.log import JsonLines

    record = logging.LogRecord("wayrisk", logging.INFO, "x", 1, "fetched %d", (3,), None)
    line = json.loads(JsonLines().format(record))
    assert (line["level"], line["logger"], line["message"]) == ("INFO", "wayrisk", "fetched 3") and line["timestamp"].endswith("+00:00")


def test_learned_model(spark, tmp_path):
    """Trained, saved, loaded and used for the intensity; without one the rules score."""
    from wayrisk.plans import domain, ingest as cycles, learned

    e = domain.events(spark, "/root/testdata/sf0.001")
    model = learned.fit(learned.training_set(e))
    path = str(tmp_path / "model")
    assert learned.load(path, spark) is None
    learned.save(model, path)
    learned.save(model, path)
    again = learned.load(path, spark)
    raw = spark.createDataFrame(raw_rows(2), feeds.RAW_EVENT)
    by_model = cycles.annotate(raw, model=again).select("intensity_score", "intensity_method").distinct().collect()
    by_rule = cycles.annotate(raw).select("intensity_score", "intensity_method").distinct().collect()
    assert [r.intensity_method for r in by_model] == ["logistic"] and [r.intensity_method for r in by_rule] == ["rule_based"] and 0 <= by_model[0].intensity_score <= 1
    assert 0 <= learned.cross_validated(learned.training_set(e), folds=2) <= 1


def test_live_run(spark, tmp_path):
    """Purged, refreshed until fresh, diagnosed and analysed."""
    from wayrisk.plans.live import live_run
    from wayrisk.sources.dimensions import gazetteer

    path, fetches = str(tmp_path / "store"), []
    fetch = lambda: fetches.append(1) or [spark.createDataFrame(raw_rows(3), feeds.RAW_EVENT)]
    requests = spark.createDataFrame([(1, 10.0, 50.0, 16.0, 40.0), (2, None, None, 1.0, 1.0)], "route_id int, olat double, olon double, dlat double, dlon double")
    purged, status, modes = live_run(spark, path, requests, fetch, now(), gazetteer(spark), cycles=2)
    got = {(r.route_id, r.mode): r for r in modes.collect()}
    assert purged == 0 and len(fetches) == 2 and status.first().total == 1 and len(got) == 6
    assert got[2, "air"].status == "UNKNOWN" and got[2, "air"].safety_score is None and got[2, "sea"].message == "Sea route could not be computed" and got[1, "sea"].risk_score > 0


def test_legacy_cycle(spark):
    from wayrisk.plans.ingest import legacy_cycle
    from wayrisk.sources.dimensions import gazetteer

    got = legacy_cycle(spark.createDataFrame(raw_rows(2) + [("x", "a recipe that is long enough, from Istanbul", "gdelt", "", "", None, None, None, None, None)], feeds.RAW_EVENT), now(), gazetteer(spark)).collect()
    assert {(r.event_id, r.lat) for r in got} == {("e0", 13.5), ("e1", 13.5), ("x", 41.01)}
