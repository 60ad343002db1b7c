"""Writers of the event store and of results."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def absent(new: DataFrame, stored: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows of ``new`` whose key isn't stored, each key once (K1, J10). Stored rows are never updated."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def insert_absent(new: DataFrame, path: str, key: str = "event_id", watch: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append the absent rows, by the day of ingestion (K1-K3). ``new`` should hold one cycle; ``watch`` sees the rows that are written."""
    spark = new.sparkSession
    rows = new.withColumn("ingest_date", F.to_date("ingested_at"))
    if exists(spark, path):
        rows = absent(rows, spark.read.parquet(path), key)
    else:
        rows = rows.dropDuplicates([key])
    if watch:
        rows = watch(rows)
    rows.write.mode("append").partitionBy("ingest_date").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def without_source(events: DataFrame, source: str = "seed") -> DataFrame:
    """What is left after deleting a source (K4, P5)."""
    return events.where(~F.col("source").eqNullSafe(source))


def purge(spark: SparkSession, path: str, source: str = "seed") -> int:
    """Delete a source from the store and tell how many events it had (K4). Only days that hold any of them are written anew."""
    if not exists(spark, path):
        return 0
    stored = spark.read.parquet(path)
    gone = stored.where(F.col("source").eqNullSafe(source)).groupBy("ingest_date").count().collect()  # a row for each day
    if gone:
        days = without_source(stored.where(F.col("ingest_date").isin([r.ingest_date for r in gone])), source)
        kept = f"{path.rstrip('/')}-purge-{uuid.uuid4().hex}"  # beside the store, as files can't be read while they are written over
        days.write.partitionBy("ingest_date").parquet(kept)
        left = {r.ingest_date for r in days.select("ingest_date").distinct().collect()}
        rewritten = spark.read.schema(stored.schema).parquet(kept)
        rewritten.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_date").parquet(path)
        for day in [r.ingest_date for r in gone if r.ingest_date not in left]:
            _delete(spark, f"{path.rstrip('/')}/ingest_date={day}")
        _delete(spark, kept)
    return sum(r["count"] for r in gone)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def wait_for(spark: SparkSession, path: str, tries: int = 5, seconds: float = 2.0, sleep=time.sleep) -> None:
    """Return once the store's file system answers (T10): ``tries`` attempts, each pause twice the last; then the last error is raised."""
    for k in range(tries):
        try:
            exists(spark, path)
            return
        except Exception:
            if k == tries - 1:
                raise
            sleep(seconds * 2**k)


def live(events: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Events ingested within the time to live (K5, T5); a predicate on the partition column prunes old days."""
    return events.where(F.unix_micros("ingested_at") > F.unix_micros(now) - hours * 3_600_000_000)


def to_document(events: DataFrame) -> DataFrame:
    return events.withColumnRenamed("event_id", "_id")


def from_document(documents: DataFrame) -> DataFrame:
    return documents.withColumnRenamed("_id", "event_id")


def response(modes: DataFrame) -> DataFrame:
    """(route_id, response): a JSON object of each route's modes (K8)."""
    inner = F.struct(*(c for c in modes.columns if c not in ("route_id", "mode")))
    return modes.groupBy("route_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", inner.alias("result")))))).alias("response"))
