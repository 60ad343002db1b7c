"""Continuous ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayrisk.plans.ingest import store_cycle
from wayrisk.sources.dimensions import gazetteer
from wayrisk.sources.feeds import RAW_EVENT, fan_in
from wayrisk.sources.sinks import exists


def landed(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A stream of landed RAW_EVENT Parquet files, each event id once within 72 hours of its arrival.

    The watermark follows arrival, not publication: a feed's date in the far future would else make all later events late.
    What is stale by its date is dropped by the cycle. A micro-batch, the first one too, takes at most ``files`` files.
    """
    raw = spark.readStream.schema(RAW_EVENT).option("maxFilesPerTrigger", files).parquet(path).withColumn("arrived_at", F.current_timestamp())
    return raw.withWatermark("arrived_at", "72 hours").dropDuplicatesWithinWatermark(["event_id"]).drop("arrived_at")


def ingest(raw: DataFrame, store: str, checkpoint: str, once: bool = False, seconds: int = 180, now=None, metrics: str | None = None) -> StreamingQuery:
    """Run a cycle on each micro-batch: keep-first within it, incidents inserted if absent.

    ``once`` takes what is there and ends; else a cycle starts every ``seconds``. With ``metrics``, each cycle's counts are appended there.
    """

    def batch(df: DataFrame, _: int) -> None:
        at = now if now is not None else F.current_timestamp()
        store_cycle(fan_in([df]), store, at, gazetteer(df.sparkSession), metrics)

    writer = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def needs_fetch(spark: SparkSession, store: str, now, least: int = 10, minutes: int = 10) -> bool:
    """Whether the store has too few events or none recent."""
    if not exists(spark, store):
        return True
    row = spark.read.parquet(store).where("source <> 'seed'").agg(F.count(F.lit(1)).alias("n"), (F.unix_micros(now) - F.unix_micros(F.max("ingested_at"))).alias("age")).first()
    return row.n < least or row.age > minutes * 60_000_000
