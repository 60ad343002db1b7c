"""Text functions, normalisers and clustering."""

import collections
import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from wayrisk.functions import text as T
from wayrisk.functions.python_text import model_places_udf, normal_place, normalize_places, place_finder, place_or_empty, similar, titled
from wayrisk.operators.clusters import cluster_incidents, clusters
from wayrisk.sources.dimensions import PLACES, keyword_rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("US", "United States"), ("UK", "United Kingdom"), ("UAE", "United Arab Emirates"), ("ukraine", "Ukraine"), ("DPRK", "North Korea"), ("  Cairo  ", "Cairo"), ("U.S.", None), ("Iran's", "Iran"), ("NEW DELHI", "New Delhi")])
def test_places(raw, want):
    assert normal_place(raw) == want or (want is None and normal_place(raw) in (None, "U.S"))


@pytest.mark.parametrize("raw", ["AP", "NATO", "BBC", "2026", "A", "", "###", "http://example.com", "BREAKING", None])
def test_no_places(raw):
    assert normal_place(raw) is None


def test_titles():
    assert titled(["bab el-mandeb", " Bab El-Mandeb", "red sea"]) == ["Bab El-Mandeb", "Red Sea"]


def test_similarity_drops_popular_letters_from_200():
    a = "".join(chr(97 + i % 26) for i in range(200))
    assert similar(a[:199], a[1:200]) > 0.98 and similar(a, a[1:] + "a") < 0.5


def test_classify(spark):
    c = one(spark, T.classify(F.lit("Army and navy hold a military exercise, warning issued")))
    assert c.label == "military" and c.confidence > 0.5 and c.scores["conflict"] > 0
    c = one(spark, T.classify(F.lit("a quiet day")))
    assert (c.label, c.confidence, c.scores["safe"]) == ("safe", 0.5, 0.5)
    assert one(spark, T.classify(F.lit(None).cast("string"))).label == "safe"


def test_classify_brute_force(spark):
    """Every keyword where a word begins, one search each, over texts that join and break keywords and words of other alphabets."""
    rules, rng = keyword_rows(), random.Random(3)
    words = [w for _, _, w, _ in rules] + ["é", "ß", "_", "9", "войн", "x", "", "\u0301", "İ"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "", "-", "\n", "é", "s "]) for _ in range(rng.randint(0, 9))) for _ in range(400)] + ["", None]

    def want(text):
        hits = {}
        for o, label, w, x in rules:
            if re.search(r"(?<!\w)" + re.escape(w), (text or "").lower()):
                hits.setdefault((o, label), []).append(x)
        scores = {k: round(min(0.30 + 0.65 * (min(len(v) / 3, 1) + min(sum(v) / 3, 1)) / 2, 0.95), 4) for k, v in hits.items()}
        best = min(scores, key=lambda k: (-scores[k], k[0]), default=None)
        return (best[1], scores[best]) if best else ("safe", 0.5)

    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", T.classify(F.col("text")).alias("c"))
    got = {r.i: (r.c.label, pytest.approx(r.c.confidence, abs=1e-4)) for r in df.collect()}
    assert {i: want(t) for i, t in enumerate(texts)} == got


def test_relevance_traps(spark):
    relevant = lambda t: one(spark, T.relevant(F.lit(t)))
    assert relevant("Troops and missile near the red carpet event") and not relevant("Celebrity gossip from the red carpet") and not relevant("war")
    # stems only match as whole words
    assert not relevant("the movie review of sanctions and casualties")


@pytest.mark.parametrize(("url", "domain", "score", "tier"), [("https://www.bbc.co.uk/news", "bbc.co.uk", 0.95, "tier1"), ("http://uk.reuters.com:80/x", "uk.reuters.com:80", 0.30, "unknown"), ("https://edition.cnn.com/x", "edition.cnn.com", 0.76, "tier2"), ("https://a.gov/x", "a.gov", 0.75, "tier2"), ("https://who.int", "who.int", 0.5, "tier3"), ("https://mynews.com", "mynews.com", 0.45, "tier3"), ("", "unknown", 0.30, "unknown"), (None, "unknown", 0.30, "unknown")])
def test_sources(spark, url, domain, score, tier):
    v = one(spark, T.verify(F.lit(url).cast("string"), F.lit("")))
    assert (v.domain, v.credibility_score, v.credibility_tier) == (domain, score, tier)


def test_publisher(spark):
    v = one(spark, T.verify(F.lit("https://x.example/1"), F.lit("BBC News")))
    assert v.credibility_score == 0.95 and v.credibility_tier == "tier1"


def test_validity(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    ok = lambda t, u, p: one(spark, T.valid_event(F.lit(t).cast("string"), F.lit(u).cast("string"), F.lit(p).cast("timestamp"), now))
    long = "a text that is long enough"
    assert not ok("too short", "", None) and not ok(long, "ftp://x", None) and not ok(long, "http://x", "2024-01-01") and ok(long, None, "2024-02-09") and ok(long, "https://x", None) and not ok(None, "", None)


def test_tags(spark):
    assert one(spark, T.geo_tag(F.lit("Houthi attack in the Red Sea"))).zone == "Red Sea / Bab el-Mandeb"
    assert one(spark, T.geo_tags(F.lit("Houthi attack in the Red Sea"))) == ["Red Sea / Bab el-Mandeb", "Yemen"]


def test_incidents(spark):
    t = dt.datetime(2024, 1, 30, 12)
    rows = [
        (0, "Red Sea shipping attack disrupts cargo vessels near Bab el-Mandeb", "piracy", 14.0, 43.0, t, "Reuters", "https://r/1", None, "rss", 0.8, 0.95),
        (1, "Cargo vessels disrupted after Red Sea shipping attack", "piracy", 14.1, 43.1, t + dt.timedelta(hours=2), "BBC", "https://b/1", "http://i", "rss", 0.6, 0.9),
        (2, "Earthquake shakes northern Chile", "disaster", -33.0, -71.0, t, "AP", "https://a/1", None, "rss", 0.5, 0.9),
        (3, "Red Sea shipping attack disrupts cargo vessels near Bab el-Mandeb", "piracy", None, None, None, "", "", None, "rss", 0.0, 0.0),
    ]
    schema = "ord long, raw_text string, label string, lat double, lon double, published_at timestamp, publisher string, source_url string, image_url string, source string, intensity_score double, credibility_score double"
    got = {r.cluster: r for r in cluster_incidents(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {0, 2} and got[0].publishers == ["Reuters", "BBC"] and got[0].corroboration_count == 2 and got[0].cluster_size == 3
    assert got[0].intensity_score == 0.7 and got[0].image_url == "http://i" and got[0].canonical_event_id.startswith("incident-")
    assert cluster_incidents(spark.createDataFrame([], schema)).count() == 0


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def cosine(a, b):
    from wayrisk.sources.dimensions import STOPWORDS

    x, y = (collections.Counter(w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 2 and w not in STOPWORDS) for t in (a, b))
    norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return sum(x[w] * y[w] for w in x) / max(norm, 1e-9) if x and y else 0.0


def test_incidents_brute_force(spark):
    """The greedy pass over all reports in order, with and without coordinates, times and labels."""
    rng = random.Random(5)
    texts = ["Port blockade halts cargo ships", "Port blockade halts container ships today", "Cargo ships halted by port blockade", "Earthquake shakes the coast", "Strong earthquake shakes coast towns", "Army moves to the border", "Army units move toward border", ""]
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(160):
        place = (rng.choice([10.0, 10.4, 10.9, 40.0]), rng.choice([179.9, -179.8, 20.0])) if rng.random() > 0.15 else (None, None)
        when = start + dt.timedelta(hours=rng.randint(0, 90)) if rng.random() > 0.15 else None
        rows.append((i, rng.choice(texts), rng.choice(["a", "b", "", None]), *place, when))
    df = spark.createDataFrame(rows, "ord long, raw_text string, label string, lat double, lon double, published_at timestamp")

    def same(x, y):
        sim = max(similar(x[1], y[1]), cosine(x[1], y[1]))
        alike = sim >= 0.45 or (sim >= 0.25 and (not x[2] or not y[2] or x[2] == y[2]))
        soon = x[5] is None or y[5] is None or abs(x[5] - y[5]) <= dt.timedelta(hours=24)
        return alike and soon and (x[3] is None or y[3] is None or km(*x[3:5], *y[3:5]) <= 100)

    want, heads = {}, []
    for r in rows:
        head = next((h for h in heads if same(h, r)), None)
        if head is None:
            heads.append(r)
        want[r[0]] = r[0] if head is None else head[0]
    assert {r.ord: r.cluster for r in clusters(df).collect()} == want and 8 < len(heads) < 120


def test_incidents_of_many_reports(spark, monkeypatch):
    """Reports of a few kinds aren't paired with each other, and stretches of the order give what the greedy pass gives."""
    from wayrisk.operators import clusters as module

    rng, start = random.Random(6), dt.datetime(2024, 1, 1)
    texts = ["Port blockade halts cargo ships", "Cargo ships halted by port blockade", "Army moves to the border"]
    rows = [(i, rng.choice(texts), rng.choice("ab"), rng.choice([10.0, 10.4, 40.0]), 20.0, start + dt.timedelta(seconds=rng.randint(0, 300_000))) for i in range(1500)]
    df = spark.createDataFrame(rows, "ord long, raw_text string, label string, lat double, lon double, published_at timestamp")
    sim = {(a, b): max(similar(a, b), cosine(a, b)) for a in texts for b in texts}
    want, heads = {}, []
    for r in rows:
        near = lambda h: abs(h[3] - r[3]) < 1 and abs(h[5] - r[5]) <= dt.timedelta(hours=24)  # noqa: B023, E731
        head = next((h for h in heads if near(h) and (sim[h[1], r[1]] >= 0.45 or (sim[h[1], r[1]] >= 0.25 and h[2] == r[2]))), r)
        heads += [r] * (head is r)
        want[r[0]] = head[0]
    sizes, keep = [], module.cut

    def counted(df):
        out = keep(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(module, "cut", counted)
    got = {r.ord: r.cluster for r in clusters(df, stretch=200).collect()}
    assert got == want and 10 < len(heads) < 100 and max(sizes) <= len(rows)


def test_names_found():
    """One pass over the words finds what each name's own pattern finds."""
    find = place_finder(PLACES)
    text = "South Sudan and sudan; NIGER, Nigeria's bab el-mandeb, the Taiwan Strait (Red  Sea, red sea). \u0130ran \u0131raq \u212aenya Guinea_ xIran Iran2 Ukraine-Russia Gulf of Aden, gulf of"
    want = {m.span() for n in PLACES for m in re.finditer(rf"\b{re.escape(n)}\b", text, re.IGNORECASE)}
    assert set(find(text)) == want and len(want) > 14 and find("") == []
    assert len(PLACES) == 203 and {"Ukraine", "Israel", "Yemen", "Syria", "Taiwan", "Turkey"} <= set(PLACES)


def test_name_columns(spark):
    df = spark.createDataFrame([(["US", "ukraine", "Ukraine", "NATO", None],), (None,)], "n array<string>")
    assert [r.x for r in df.select(normalize_places("n").alias("x")).collect()] == [["United States", "Ukraine"], []]
    assert [one(spark, place_or_empty(F.lit(x))) for x in ("uk", "BBC", " S. Korea ", "new\x00 delhi's")] == ["United Kingdom", "", "South Korea", "New Delhi"]
    with pytest.raises(ImportError):
        model_places_udf()
