"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's ``freqItems``: the Karp-Papadimitriou-Shenker counters, merged over
partitions) names at most ``1 / SUPPORT`` digests that may be frequent. An exact count over only
those digests, reduced map-side to one row each, verifies them and finds their winners. The verified
winners, at most ``1 / SUPPORT`` rows whatever the input's size, are broadcast and settle their copies
map-side, without a shuffle. All other digests go through an ordinary shuffle: a map-side combined
aggregate for the winners, joined back on the digest (which adaptive execution can split). Digests are computed once,
into a checkpointed table of ids and digests that all of this reads instead of the texts.

Defined results: a null text counts as the empty text, and empty texts equal each other. Of a group
the row with the largest ``doc_id`` stays; null ids lose to any other. ``mark_copies`` names rows by id:
a group of null ids only keeps none (``keep_id`` null, ``kept`` false), and rows that repeat both id and
text share their verdict. ``drop_copies`` keeps exactly one row of every group. An empty table gives an empty result. Other columns, whatever
their names, pass through ``drop_copies`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.llm._shared import checkpoint, fresh

#: The summary finds each digest that has over this share of all rows, and names at most 1 / SUPPORT.
SUPPORT = 1 / 1000


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256))


def _winners(slim: DataFrame, support: float) -> tuple[DataFrame, DataFrame]:
    """(heavy, light): digest, keep, size of the frequent and of all other digests of ``slim`` (digest, id)."""
    count = [F.max("id").alias("keep"), F.count(F.lit(1)).alias("size")]
    slim = slim.withColumn("key", F.xxhash64("digest"))  # eight bytes for each of the summary's counters
    frequent = slim.freqItems(["key"], support).select(F.explode("key_freqItems").alias("key"))
    frequent = F.broadcast(checkpoint(frequent))  # fixed once: the summary depends on the order in which parts arrive
    heavy = slim.join(frequent, "key", "left_semi").groupBy("digest").agg(*count)
    light = slim.join(frequent, "key", "left_anti").groupBy("digest").agg(*count)
    return F.broadcast(checkpoint(heavy)), light  # 1 / support rows at most


def mark_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    slim = checkpoint(docs.select(F.col(f"`{doc_id}`").alias("id"), _digest(text).alias("digest")))
    heavy, light = _winners(slim, support)
    settled = slim.join(heavy, "digest")
    rest = slim.join(heavy, "digest", "left_anti").join(light.hint("merge"), "digest")
    return settled.unionByName(rest).select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        F.coalesce(F.col("id") == F.col("keep"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """Exactly one row of ``docs`` for each text, with all its columns.

    It is the one with the largest id, null ids last; among rows of that id the hash of the whole row
    decides (without columns that hold maps, which have no hash), and of equal rows any one stays.
    """
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rank = F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(*hashed).alias("row"))
    slim = checkpoint(docs.select(rank.alias("id"), _digest(text).alias("digest")))
    heavy, light = _winners(slim, support)
    mine, digest, keep = (fresh(docs, x) for x in ("rank", "digest", "keep"))
    named = lambda winners: winners.select(F.col("digest").alias(digest), F.col("keep").alias(keep))

    def once(rows: DataFrame) -> DataFrame:
        # the largest rank of a digest; as an equality it would be a key of the join, and rows be shuffled by it and again
        return rows.where(F.col(mine) >= F.col(keep)).dropDuplicates([digest]).select(*(F.col(f"`{c}`") for c in docs.columns))

    ranked = docs.withColumns({mine: rank, digest: _digest(text)})
    settled = ranked.join(F.broadcast(named(heavy)), digest)
    rest = ranked.join(F.broadcast(named(heavy)), digest, "left_anti").join(named(light).hint("merge"), digest)
    return once(settled).unionByName(once(rest))
