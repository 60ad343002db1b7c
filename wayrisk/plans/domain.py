"""The generic tables as news events and route requests, deterministically, so that SQL can state the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The reference time of all queries over the tables.
NOW = "2024-01-31 00:00:00"
LABELS = ["conflict", "terrorism", "sanction", "protest", "disaster", "safe", "military", "shipping", "piracy", "cyber", "airspace", "diplomacy"]
SOURCES = ["gdelt", "rss", "newsapi", "gnews", "seed", "rss"]
PUBLISHERS = ["Reuters", "BBC News", "Harbor Post", "", "Daily Ledger"]
#: Own wordings that the text operators react to, some of them not at all.
TEXTS = [
    "Troops moved toward the border after a missile struck the depot",
    "Port closure delays container ship traffic in the Red Sea",
    "New sanctions and an export control target tanker owners",
    "Protest and unrest spread through the capital, police use tear gas",
    "Earthquake and tsunami warning issued for the coast",
    "Ministers praise cooperation and sign a trade agreement",
    "Pirates hijack vessel in the Gulf of Aden and demand ransom",
    "Ransomware and data breach hit critical infrastructure",
    "Airspace closure forces flight diversion over Ukraine",
    "Premier league match result surprises the fans again",
    "Recipe of the week: soup from the royal family kitchen",
    "Houthi drone strike damages cargo ship near Yemen",
    "Militants take hostage in Kabul as explosion kills civilians",
    "Army and navy hold a military exercise in the South China Sea",
    "Flood and landslide displace thousands, relief effort begins",
    "Coup attempt in Sudan as junta forces clash in Khartoum",
    "Short note",
    "Strait of Hormuz shipping lane reopens after blockade and siege",
    "Peace talks and ceasefire negotiation resume at the summit",
    "Smartphone and gadget reviews for the season",
    "Shelling and artillery fire near the frontline, many killed and wounded",
    "Tariff and embargo dispute deepens into a trade war",
    "Wildfire and drought threaten supply chain and freight",
    "Local bakery wins a ribbon at the yearly spring fair downtown",
]


def pick(values: list, by: Column) -> Column:
    """The value at ``by`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def pick_sql(values: list, by: str) -> str:
    quoted = ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[CAST({by} % {len(values)} AS INTEGER) + 1]"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    publisher = pick(PUBLISHERS, u)
    return e.select(
        i.cast("string").alias("event_id"),
        i.alias("ord"),
        pick(TEXTS, i).alias("raw_text"),
        pick(SOURCES, u).alias("source"),
        publisher.alias("publisher"),
        F.when(i % 3 == 0, F.array(publisher)).otherwise(F.array().cast("array<string>")).alias("publishers"),
        F.concat(F.lit("https://www.site"), (i % 50).cast("string"), F.lit(".example.org/"), i.cast("string")).alias("source_url"),
        (((i * 7919) % 14000) / 100.0 - 70).alias("lat"),
        (((i * 104729) % 36000) / 100.0 - 180).alias("lon"),
        pick(LABELS, i).alias("label"),
        (0.30 + (i % 66) / 100.0).alias("label_confidence"),
        F.least(F.greatest(F.col("value") / 200.0, F.lit(0.0)), F.lit(1.0)).alias("intensity_score"),
        F.col("ts").cast("timestamp").alias("published_at"),
        F.lit("2").alias("schema_version"),
        (1 + i % 4).cast("int").alias("corroboration_count"),
        F.lit(None).cast("string").alias("image_url"),
        (0.3 + (i % 5) / 10.0).alias("credibility_score"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route from each nation to another one."""
    k = F.col("n_nationkey").cast("long")
    d = (k + 7) % 25
    lat, lon = lambda x: ((x * 37) % 120 - 50).cast("double"), lambda x: ((x * 73) % 340 - 170).cast("double")
    return table(spark, sf_dir, "nation").select(k.alias("route_id"), lat(k).alias("olat"), lon(k).alias("olon"), lat(d).alias("dlat"), lon(d).alias("dlon"))


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lane_id, idx, lat, lon): lanes between the ports of nations, one to the next nation and one to the fifth after, each with a few points between.

    The last two nations have no port.
    """
    k = F.col("n_nationkey").cast("long")
    n = table(spark, sf_dir, "nation").where(k < 23).select(k.alias("k"), F.explode(F.array(F.lit(1), F.lit(5))).alias("far"))
    to = F.pmod(F.col("k") + F.col("far"), F.lit(23))
    lat, lon = lambda x: ((x * 37) % 120 - 50).cast("double"), lambda x: ((x * 73) % 340 - 170).cast("double")
    n = n.select((F.col("k") * 10 + F.col("far")).alias("lane_id"), *(f(x).alias(name) for name, f, x in (("a", lat, F.col("k")), ("b", lon, F.col("k")), ("c", lat, to), ("d", lon, to))), (F.col("k") % 4 + 2).alias("n"))
    p = n.select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("idx"))
    t = F.col("idx") / F.col("n")
    return p.select("lane_id", "idx", (F.col("a") + (F.col("c") - F.col("a")) * t).alias("lat"), (F.col("b") + (F.col("d") - F.col("b")) * t).alias("lon"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route for each supplier, from half a degree off its nation's port to another nation's."""
    k, i = F.col("s_nationkey").cast("long"), F.col("s_suppkey").cast("long")
    d = (k + i % 24 + 1) % 25
    lat, lon = lambda x: ((x * 37) % 120 - 50).cast("double"), lambda x: ((x * 73) % 340 - 170).cast("double")
    return table(spark, sf_dir, "supplier").select(i.alias("route_id"), (lat(k) + 0.5).alias("olat"), (lon(k) + 0.25).alias("olon"), (lat(d) - 0.25).alias("dlat"), (lon(d) + 0.5).alias("dlon"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): whole documents behind wordings that the operators react to."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(pick(TEXTS, F.col("doc_id")), F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, ts, seq, outcome) of attempts to fetch."""
    e = table(spark, sf_dir, "events")
    return e.select(pick(["rss", "gdelt", "newsapi", "gnews"], F.col("user_id")).alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), pick(["ok", "fail", "429", "ok", "fail", "fail", "exhausted"], F.floor(F.col("event_id") / 3)).alias("outcome"))
