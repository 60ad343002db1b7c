"""Document fingerprints by locally consistent parsing.

A text's code points are the names of level 0. Each level is cut into phrases, and each phrase becomes one name of the next level:

1. A run of equal names becomes one name, so that neighbours differ.
2. Deterministic coin tossing: a name's label is twice the lowest bit in which it differs from its left neighbour, plus
   that bit. Labels of neighbours differ as well. Four rounds bring 64 bits down to six labels.
3. A phrase begins at every local maximum of the labels, so it has 2 to 11 names, and where it begins depends on a few names
   to either side only. Its name is a 64-bit hash of its names.

So equal substrings are cut alike, whatever their offset and what surrounds them, but for a few names at either end of each
level; the names of their interior phrases are the same. Parsing ends at one name, the root.

The fingerprint holds the root's name and a sketch of the set of phrase names from level ``LEVEL`` up (phrases of some
ten code points and more; for texts that end at it or below, from the level under their root): 64 bins by hash, of each the smallest name's 12 bits. The likeness of two
fingerprints is the share of bins in which they agree, among those that either fills, an estimate of the overlap
of the two sets of phrases. Equal texts have equal fingerprints and likeness 1.

A document's neighbour is the document of the next larger id. Texts are dealt out once, by ranges of (id, hash, row), so that an id that very many
rows share spreads over partitions, and go by in descending order: a task holds a batch, the text that stands for the id before, and nothing else. Documents
whose neighbour lies in another partition are written down as open, with the texts at the ends of partitions; they are settled afterwards,
by a join on the partition. Only ids at partition ends (three values for each partition) reach the driver.

Defined results: a null text is empty; the empty text has the root 0 and an empty sketch, whose likeness to another empty one is 1 and to any other 0.
A null id comes before all others. Rows that repeat an id have the same neighbour, and of several texts of one id
the one with the smallest hash stands for it as a neighbour; a table with one id neighbours itself. Texts are parsed whole. An empty table gives an empty result; columns other than the two
named are not read. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk.llm._shared import checkpoint, mixed

#: Phrases from this level up are in the sketch.
LEVEL = 2
BINS, BITS = 64, 12
#: Code points that are parsed at once (one text at least).
_CHUNK = 200_000
_RUN, _PHRASE = np.uint64(0xD6E8FEB86659FD93), 0x9E3779B97F4A7C15
#: Factors of a phrase's places; a phrase is shorter than that.
_FACTORS = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(_PHRASE)) | np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_DIGITS = np.array([f"{v:03x}" for v in range(1 << BITS)] + ["---"], "S3")


def _tossed(x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which names differ from their left neighbours, plus that bit of theirs."""
    differ = x ^ left
    low = differ & (~differ + x.dtype.type(1))
    return (np.bitwise_count(low - x.dtype.type(1)) << np.uint8(1)) | ((x & low) != 0)


#: Labels of a later round, by own label and left neighbour's; the first round gives labels under 128.
_LATER = _tossed(*(a.astype(np.uint8) for a in np.divmod(np.arange(1 << 14), 128))).astype(np.int16)


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Four rounds of coin tossing; a document's first name differs from its missing neighbour in the lowest bit."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = ~x[first]
    label = _tossed(x, left).astype(np.int16)
    for _ in range(3):
        start = label[first] & 1
        pair = label << 7
        pair[1:] |= label[:-1]
        label = _LATER[pair]
        label[first] = start
    return label


def phrase_starts(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin in names ``x`` without equal neighbours; ``first`` has the places where documents begin."""
    label = _labels(x, first)
    higher = np.empty(len(x) + 1, bool)  # place i has a higher label than its left neighbour
    higher[0] = higher[-1] = False
    higher[1:-1] = label[1:] > label[:-1]
    top = higher[:-1].copy()
    top[:-1] &= ~higher[1:-1]
    # neither a document's second name nor its last begins a phrase
    second = first + 1
    top[second[second < len(x)]] = False
    top[np.append(first[1:], len(x)) - 1] = False
    top[first] = True
    return np.flatnonzero(top)


def collapse(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names with each run of equal names made one name, and where documents begin."""
    new = np.empty(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[first] = True
    at = np.flatnonzero(new)
    if len(at) == len(x):
        return x.astype(np.uint64, copy=False), first
    names = x[at].astype(np.uint64, copy=False)
    length = np.diff(np.append(at, len(x)))
    runs = np.flatnonzero(length > 1)
    names[runs] = mixed(names[runs] * _RUN + length[runs].astype(np.uint64))
    return names, np.searchsorted(at, first)


def levels(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, names, documents) from level 1 up; a document ends with the level that has one name of it."""
    x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    doc = np.flatnonzero(size)  # the documents that go on
    first = (np.cumsum(size) - size)[doc]
    level = 0
    while len(doc):
        x, first = collapse(x, first)
        at = phrase_starts(x, first)
        place = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
        level += 1
        # names are hashes already, and code points small: a sum with random factors, then mixed, is a hash of the phrase
        x = mixed(np.add.reduceat(x * _FACTORS[place], at) + np.uint64(level))
        first = np.searchsorted(at, first)
        size = np.diff(np.append(first, len(x)))
        of = np.repeat(doc, size)
        yield level, x, of
        if (size == 1).any():
            going = size > 1
            x, doc, size = x[np.repeat(going, size)], doc[going], size[going]
            first = np.cumsum(size) - size


def fingerprints(texts: list[str]) -> list[str]:
    """Root (16 hexadecimal digits), a colon, then three digits for each bin, ``---`` where it is empty."""
    n = len(texts)
    root, sketch = np.zeros(n, np.uint64), np.full(n * BINS, _NONE)
    under: tuple[np.ndarray, np.ndarray] | None = None
    for level, x, doc in levels(texts):
        ends = np.bincount(doc, minlength=n) == 1
        at = ends[doc]
        root[doc[at]] = x[at]
        if level <= LEVEL and under:
            own = ends[under[1]]
            _into(sketch, under[0][own], under[1][own])
        if level < LEVEL:
            _into(sketch, x[at], doc[at])
            under = x, doc
        else:
            _into(sketch, x, doc)
    digits = _DIGITS[np.where(sketch == _NONE, np.uint64(1 << BITS), sketch & np.uint64((1 << BITS) - 1)).astype(np.int64)].tobytes().decode()
    width = 3 * BINS
    return [f"{r:016x}:{digits[i * width : (i + 1) * width]}" for i, r in enumerate(root.tolist())]


def _into(sketch: np.ndarray, names: np.ndarray, doc: np.ndarray) -> None:
    """Names go into their bins' minima."""
    h = mixed(names * _FACTORS[0])
    np.minimum.at(sketch, doc.astype(np.int64) * BINS + (h >> np.uint64(58)).astype(np.int64), h & np.uint64((1 << 58) - 1))


def likeness(a: str, b: str) -> float:
    """Of two written fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(f[17:].encode(), "S3") for f in (a, b))
    either = int(((x != b"---") | (y != b"---")).sum())
    return float(((x == y) & (x != b"---")).sum() / either) if either else 0.0


def _chunked(texts: list[str]) -> list[str]:
    out, part, size = [], [], 0
    for t in texts:
        if part and size + len(t) > _CHUNK:
            out += fingerprints(part)
            part, size = [], 0
        part.append(t)
        size += len(t)
    return out + (fingerprints(part) if part else [])


_RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _settled(texts: list[str], nexts: list[str], prints: list[str], next_prints: list[str]) -> list[pa.Array]:
    """The columns of ``_RESULT``."""
    edited = [t[: len(t) - len(t) // 4] + s[: len(t) // 4] for t, s in zip(texts, nexts, strict=True)]
    shas = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    again = _chunked(edited)
    near = [likeness(a, b) for a, b in zip(prints, again, strict=True)]
    other = [likeness(a, b) for a, b in zip(prints, next_prints, strict=True)]
    return [pa.array([len(t) for t in texts], pa.int64()), pa.array(shas, pa.string()), pa.array(prints, pa.string()), pa.array(again, pa.string()), pa.array(near, pa.float64()), pa.array(other, pa.float64())]


def _neighboured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (place, doc_id, text) by descending place: settled rows, open ones with their text, and the texts at the partition's end.

    ``kind`` is 0 for settled, 1 for open, 2 for the text that stands for the partition's smallest place, 3 for the text
    that stands for the place before it.
    """
    part = TaskContext.get().partitionId()
    place = here = after = None  # the place of the rows that go by, the text that stands for it so far, and the next place's
    for b in batches:
        texts = [t or "" for t in b.column(2).to_pylist()]
        prints = _chunked(texts)
        places = b.column(0).to_pylist()
        nexts: list[tuple[str, str] | None] = []
        for p, t, f in zip(places, texts, prints, strict=True):
            if p != place:
                after, place = here, p
            here = t, f
            nexts.append(after)
        known = [i for i, s in enumerate(nexts) if s is not None]
        unknown = [i for i, s in enumerate(nexts) if s is None]
        pick = lambda values, at: [values[i] for i in at]
        if known:
            columns = _settled(pick(texts, known), [nexts[i][0] for i in known], pick(prints, known), [nexts[i][1] for i in known])
            yield _rows(part, 0, pick(places, known), b.column(1).take(pa.array(known)), pa.nulls(len(known), pa.string()), columns)
        if unknown:
            columns = [pa.nulls(len(unknown), pa.int64()), *(pa.nulls(len(unknown), pa.string()) for _ in range(3)), *(pa.nulls(len(unknown), pa.float64()) for _ in range(2))]
            yield _rows(part, 1, pick(places, unknown), b.column(1).take(pa.array(unknown)), pa.array(pick(texts, unknown), pa.string()), columns)
    for kind, end in ((2, here), (3, after)):
        if end is not None:
            none = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([end[1]]), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
            yield _rows(part, kind, [place], pa.nulls(1, pa.int64()), pa.array([end[0]], pa.string()), none)


def _rows(part: int, kind: int, places: list[int], ids: pa.Array, texts: pa.Array, columns: list[pa.Array]) -> pa.RecordBatch:
    n = len(places)
    names = ["part", "kind", "place", "doc_id", "text", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array(places, pa.int64()), ids, texts, *columns], names=names)


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, next text, its fingerprint), the settled rows."""
    for b in batches:
        texts, nexts, prints = (b.column(k).to_pylist() for k in (1, 2, 3))
        columns = _settled(texts, nexts, _chunked(texts), prints)
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _sources(ends: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int]]:
    """(partition, where, kind): where the neighbour of a partition's open rows is, from (partition, largest place, smallest place, whether it has several)."""
    ends = sorted(ends)
    smallest = ends[-1][0] if ends else 0
    out = []
    for i, (part, largest, _, _) in enumerate(ends):
        where, kind = smallest, 2  # after the last comes the first
        for j in range(i - 1, -1, -1):
            other, _, low, several = ends[j]
            if low != largest:
                where, kind = other, 2
                break
            if several:
                where, kind = other, 3
                break
        out.append((part, where, kind))
    return out


def fingerprint_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    own, body = F.col(f"`{doc_id}`").cast("long"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    place = F.coalesce(own, F.lit(-(1 << 63)))
    source = docs.select(place.alias("place"), own.alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("place").desc(), F.col("hash").desc(), F.col("row").desc()]
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order).select("place", "doc_id", "text")
    done = checkpoint(dealt.mapInArrow(_neighboured, f"part int, kind int, place bigint, doc_id bigint, text string, {_RESULT}"))

    result = ["doc_id", *(c.split()[0] for c in _RESULT.split(", "))]
    settled = done.where("kind = 0").select(*result)
    ends = done.where("kind in (1, 2, 3)").groupBy("part").agg(F.max("place").alias("largest"), F.min(F.when(F.col("kind") == 2, F.col("place"))).alias("smallest"), F.max((F.col("kind") == 3).cast("int")).alias("several"))
    sources = _sources([(r.part, r.largest, r.smallest, bool(r.several)) for r in ends.collect()])  # a row for each partition
    of = spark.createDataFrame(sources, "part int, where int, kind int")
    texts = done.where("kind in (2, 3)").select(F.col("part").alias("where"), "kind", F.col("text").alias("next"), "fingerprint")
    # a partition's end goes to each partition that asks for it; partitions, not documents, are the key
    asked = of.join(texts, ["where", "kind"]).select("part", "next", "fingerprint")
    open_rows = done.where("kind = 1").select("part", "doc_id", "text").join(asked, "part").select("doc_id", "text", "next", "fingerprint")
    return settled.unionByName(open_rows.mapInArrow(_closed, f"doc_id bigint, {_RESULT}"))
