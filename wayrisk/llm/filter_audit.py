"""Audit of how document filters interact, by a packed bitmap index.

Five filters fail a document: A has under 200 words; B has fewer distinct words than half its words; C has
more than 3 % of capital letters among its code points; D holds one of ``#$%&*|``; E has the text of a document with
a smaller id. Words are runs of anything but ASCII white space, case-sensitive.

1. One pass over the texts gives a slim checkpointed row for each document: id, part, digest of the text, and a byte with the outcomes of A to D.
2. E: the smallest id of each text comes from the heavy-hitter split of exact dedup, so that a text which a third of
   all rows share is settled map-side and never lands in one task. Labels are reduced to a row for each id and joined.
3. The index: each batch of rows becomes NumPy bitsets, 64 rows to a word: one for each filter, one for good and one for toxic
   documents, and one for each part. An order of the filters only matters through the set of those applied before, so for
   each of the 32 prefix subsets, survivors are the part's bits AND-NOT the union of the prefix's filters, and popcounts with the next filter's, the good
   and the toxic bits give all counts. Counts are summed over batches in the task, then over partitions.
4. What is left is 80 counts for a part (a prefix subset and a next filter), from which the 120 orders of 5 steps and the Shapley values are read off.

Defined results: a null text counts as empty (it fails A alone: with no words and no code points B and C don't fail);
a null ``lang`` and an empty one are the part named by the empty string; rows with a null id have no labels, never fail E
and make nobody fail it; rows that repeat id and text count as often as they occur and don't fail E against each other;
labels that repeat an id count as 1 if any of them does; null labels count as 0; an empty table gives an empty result. Columns other than
those named are not read. Ids are integers.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk.llm._shared import checkpoint
from wayrisk.llm.exact_dedup import SUPPORT, _winners

FILTERS = "ABCDE"
#: Places of the other outcomes in a row's byte, after the filters.
_GOOD, _TOXIC = 5, 6
#: Rows of an index at a time, and parts whose counts a task holds before it passes them on.
_ROWS, _PARTS = 65_536, 2_048
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = re.compile(rb"[#$%&*|]")
#: Prefix subsets with each filter that may come next, in the order of the index's counts.
_STEPS = [(s, f) for s in range(32) for f in range(5) if not s >> f & 1]
_COUNTS = ["kept", "removed", "redundant", "good_lost", "toxic_lost"]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, digest, bits) of (id, part, text)."""
    for b in batches:
        bits, digests = np.zeros(b.num_rows, np.uint8), []
        for i, text in enumerate(b.column(2).to_pylist()):
            text = text or ""
            raw = text.encode()
            words = raw.split()
            few, dull = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
            loud = 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 3 * len(text)
            bits[i] = few | dull << 1 | loud << 2 | (_MARKS.search(raw) is not None) << 3
            digests.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(bits.astype(np.int16))], names=["doc_id", "part", "digest", "bits"])


def _words(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans, packed into 64-bit words."""
    flags = np.atleast_2d(flags)
    short = -flags.shape[1] % 64
    return np.packbits(np.pad(flags, ((0, 0), (0, short))), axis=1).view(np.uint64)


def index_counts(parts: np.ndarray, n_parts: int, bits: np.ndarray) -> np.ndarray:
    """Counts [part, step, count] of rows with a part's number and a byte of outcomes; steps as ``_STEPS``, then a part's unique fails as [part, filter]."""
    index = _words((bits[None, :] >> np.arange(7)[:, None] & 1).astype(bool))
    fails, good, toxic = index[:5], index[_GOOD], index[_TOXIC]
    member = _words(np.arange(n_parts)[:, None] == parts[None, :])
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    gone = np.zeros((32, index.shape[1]), np.uint64)
    for s in range(1, 32):
        low = (s & -s).bit_length() - 1
        gone[s] = gone[s & (s - 1)] | fails[low]
    out = np.zeros((n_parts, len(_STEPS) + 1, 5), np.int64)
    for k, (s, f) in enumerate(_STEPS):
        alive = member & ~gone[s]
        lost = alive & fails[f]
        out[:, k, 0] = count(alive & ~fails[f])
        out[:, k, 1] = count(lost)
        out[:, k, 2] = count(member & fails[f] & gone[s])
        out[:, k, 3] = count(lost & good)
        out[:, k, 4] = count(lost & toxic)
    for f in range(5):
        out[:, len(_STEPS), f] = count(member & fails[f] & ~gone[31 ^ 1 << f])
    return out


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, place, counts) of (part, bits): a task's sums, with a place for each step and one for unique fails."""
    held: dict[str, np.ndarray] = {}

    def passed_on() -> pa.RecordBatch:
        names = [p for p in held for _ in range(len(_STEPS) + 1)]
        flat = np.concatenate(list(held.values()))
        held.clear()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 5 * len(flat) + 1, 5, dtype=np.int32)), pa.array(flat.ravel()))
        places = np.tile(np.arange(len(_STEPS) + 1, dtype=np.int32), len(names) // (len(_STEPS) + 1))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places), lists], names=["part", "place", "counts"])

    for batch in batches:
        for first in range(0, batch.num_rows, _ROWS):
            b = batch.slice(first, _ROWS)
            coded = b.column(0).dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            bits = b.column(1).to_numpy().astype(np.uint8)
            # the bitsets of very many parts one share of parts at a time
            for low in range(0, len(names), 256):
                own = (codes >= low) & (codes < low + 256)
                some = names[low : low + 256]
                for name, counts in zip(some, index_counts(codes[own] - low, len(some), bits[own]), strict=True):
                    held[name] = held[name] + counts if name in held else counts
                if len(held) >= _PARTS:
                    yield passed_on()
    if held:
        yield passed_on()


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang", support: float = SUPPORT) -> DataFrame:
    """Rows of part, filter_order and step with kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("text"))
    slim = checkpoint(source.mapInArrow(_judged, "doc_id bigint, part string, digest binary, bits smallint"))

    # The largest complement is the smallest id's.
    heavy, light = _winners(slim.where("doc_id is not null").select(F.bitwise_not("doc_id").alias("id"), "digest"), support)
    first = F.when(F.col("size") > 1, F.bitwise_not("keep")).alias("first")
    settled = slim.join(F.broadcast(heavy.select("digest", first)), "digest")
    rest = slim.join(heavy, "digest", "left_anti").join(light.where("size > 1").select("digest", first).hint("merge"), "digest", "left")
    later = F.coalesce((F.col("doc_id") > F.col("first")).cast("smallint"), F.lit(0).cast("smallint"))
    judged = settled.unionByName(rest).select("doc_id", "part", (F.col("bits") + F.shiftleft(later, 4)).cast("smallint").alias("bits"))

    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    none = F.lit(0)
    outcome = F.col("bits") + F.shiftleft(F.coalesce("q", none), _GOOD) + F.shiftleft(F.coalesce("t", none), _TOXIC)
    index = judged.join(marks, "doc_id", "left").select("part", outcome.cast("smallint").alias("bits"))

    partial = index.mapInArrow(_indexed, "part string, place int, counts array<bigint>")
    sums = checkpoint(partial.groupBy("part", "place").agg(F.array(*(F.sum(F.col("counts")[k]) for k in range(5))).alias("counts")))
    return _orders(sums)


def _orders(sums: DataFrame) -> DataFrame:
    """All orders and steps from the 81 counts of each part."""
    spark = sums.sparkSession
    place = {step: k for k, step in enumerate(_STEPS)}
    rows = []
    for order in itertools.permutations(range(5)):
        done = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(FILTERS[x] for x in order), step, f, place[done, f]))
            done |= 1 << f
    steps = F.broadcast(spark.createDataFrame(rows, "filter_order string, step int, f int, place int"))  # 600 rows
    # how many orders have a step
    often = F.broadcast(steps.groupBy("f", "place").agg(F.count(F.lit(1)).alias("orders")))
    shapley = sums.join(often, "place").groupBy("part", "f").agg(F.sum(F.col("orders") * F.col("counts")[1]).alias("shapley"))
    alone = sums.where(F.col("place") == len(_STEPS)).select("part", F.posexplode("counts").alias("f", "unique_fails"))
    named = sums.join(steps, "place").join(shapley, ["part", "f"]).join(alone, ["part", "f"])
    value = {c: F.col("counts")[k] for k, c in enumerate(_COUNTS)}
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return named.select("part", "filter_order", "step", *(value.get(c, F.col(c)).alias(c) for c in columns))


def oracle() -> str:
    """The same audit as DuckDB SQL, order by order over the distinct outcomes."""
    return r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(doc_id > first, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, [a, b, c, d, e] AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [p.i, q.i, r.i, s.i, u.i] AS seq FROM x p, x q, x r, x s, x u WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
steps AS (SELECT seq, list_aggregate(list_transform(seq, lambda z: substr('ABCDE', z, 1)), 'string_agg', '') AS filter_order, x.i AS step FROM o, x),
c AS (SELECT *, fails[seq[step]] AS fail, len(list_filter(seq[1:step - 1], lambda z: fails[z])) > 0 AS gone, len(list_filter(fails, lambda z: z)) AS failing FROM g, steps),
k AS (SELECT part, filter_order, step, seq[step] AS letter,
        coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fail), 0) AS removed,
        coalesce(sum(n) FILTER (gone AND fail), 0) AS redundant, coalesce(sum(n) FILTER (fail AND failing = 1), 0) AS unique_fails,
        coalesce(sum(n) FILTER (NOT gone AND fail AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND fail AND toxic), 0) AS toxic_lost
      FROM c GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM k"""
