"""A pipeline that prepares a corpus: five stages, each written as Parquet and read again for the next.

quality: documents that the classifier rejects go. exact: one row for each text stays. near: one
document of each group of near copies stays. decontaminate: documents that hold a benchmark item go.
pack: what is left becomes sequences of tokens.

Null ids and texts, empty tables and repeated rows are handled as each operator's module says; other columns pass
through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wayrisk.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from wayrisk.llm._shared import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good), ("exact", exact), ("near", near), ("decontaminate", clean), ("pack", packed)]

#: Learned scores, signatures and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, through tables in the folder that the cluster shares.

    A stage's table is deleted once the next one is written; that of the last but one stays, as the result reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = f"{folder}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                old = spark._jvm.org.apache.hadoop.fs.Path(last)
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
            last = path
    return docs
