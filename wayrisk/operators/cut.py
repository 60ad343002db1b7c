"""Materialised intermediate results, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and with its lineage cut.

    It is written to the folder of ``spark.checkpoint.dir``; only a local session without one gets a temporary folder.
    Executors that are lost lose nothing of it, and it needs no release, unlike a cache.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wayrisk"))
    return df.checkpoint(eager=True)
