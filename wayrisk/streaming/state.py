"""Quota, health and rate limits of sources as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayrisk.operators.state import DAILY, STATE, Source, attempts, take_all

#: A saved state: what is shown of it, and all that goes on.
SAVED = "source string, ts double, allowed boolean, used long, failures long, cooldown_until double, suppressions long, saved string"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pdf = pd.concat(list(batches))
    # what is saved counts only until the stream has a state of its own
    source = Source.load(key[0], state.get[0] if state.exists else pdf.saved.iloc[0])
    out = take_all(source, pdf)
    state.update((source.dump(),))
    yield out


def track(log: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """The state of each source around each attempt of a streamed log (source, ts, seq, outcome).

    A new stream goes on from ``saved`` states (``load_states``): quotas, cooldowns, suppressions and limits stay in force.
    States have no timeout, as counts of failures and suppressions never lapse by time alone.
    """
    return attempts(log, saved).groupBy("source").applyInPandasWithState(_step, STATE, "saved string", "append", GroupStateTimeout.NoTimeout)


def save_states(states: DataFrame, path: str, before: DataFrame | None = None) -> None:
    """The last state of each source as JSON, over an older file (K6).

    ``before``, loaded from another path, stands for sources without a state since.
    """
    names = [c.split(" ")[0] for c in SAVED.split(", ")]
    every = states.select(*names) if before is None else states.select(*names).union(before.select(*names))
    last = every.groupBy("source").agg(F.max_by(F.struct(*names[1:]), F.struct("ts", F.col("saved").isNotNull())).alias("s"))
    last.select("source", "s.*").coalesce(1).write.mode("overwrite").json(path)


def load_states(spark: SparkSession, path: str) -> DataFrame:
    """Saved states with today's limits: the configured quota wins over what was saved."""
    saved = spark.read.schema(SAVED).json(path)
    limit = F.create_map(*(x for k, v in DAILY.items() for x in (F.lit(k), F.lit(v))))
    return saved.withColumn("daily_limit", limit[F.col("source")]).withColumn("remaining", F.greatest(F.lit(0), F.col("daily_limit") - F.col("used")))
