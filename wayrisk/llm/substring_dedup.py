"""Removal of repeated passages, found with fixed-block anchors.

A window of 35 words that occurs twice contains, in each occurrence, a whole block of 18 words that
starts at a multiple of 18 in its document (35 >= 2 * 18 - 1). So the index holds the non-overlapping
18-word blocks of every document, and every rolling 18-word window probes it; a window that meets a
block elsewhere is an anchor, and any repeated passage has one in each of its occurrences.

1. Documents are read in batches. A batch hashes its rolling windows, and groups them by hash; what
   already repeats inside the batch is an anchor at once, so that each batch sends one entry per
   hash at most, however common a passage. Entries (hash, document in the batch, whether it is a
   block) are packed into one binary per batch and hash range, and one task per range finds the
   hashes that meet a block elsewhere. Ranges are as many as the input's size asks for.
2. Documents with anchors are read again. Anchors extend to the 35-word windows around them, which
   are matched the same way by two hashes: all 64 bits of one, and of the other the range that it falls on (six bits
   or more, as many as there are ranges). Those that occur twice are repeats, and runs of them are the maximal repeated passages.
3. Each document drops the words that its repeated windows cover.

Documents meet their anchors and repeats by a shuffle on a row hash; the shuffled texts are used twice.

Defined results: words are runs of anything but ASCII white space, unchanged; null and empty
texts have none (``kept_sha256`` of the empty string); texts with fewer words than a window lose
none; long texts are processed whole; repeated rows repeat each other, so both lose their windows;
null ids are kept; an empty table gives an empty result; columns other than the two named are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk.llm._shared import WordHash, mixed, partitions, remember, text_bytes, window_hashes, word_array

WINDOW = 35
BLOCK = 18
#: A batch has about so many words, and fewer documents than 14 bits can number.
BATCH_WORDS, BATCH_DOCS = 2_000_000, 16_000
#: Bytes of text for each hash range.
RANGE_BYTES = 12_000_000
_MEMO = WordHash()
_IS_BLOCK, _REPEATS = np.uint16(1 << 14), np.uint16(1 << 15)
_DOC = np.uint16((1 << 14) - 1)
_PASSED = "g int, uid long, kind int, data binary"


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _runs(sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    at = np.flatnonzero(np.concatenate(([True], sorted_hashes[1:] != sorted_hashes[:-1]))) if len(sorted_hashes) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(sorted_hashes)))


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(ranges)).astype(np.uint32)


def _short(h: np.ndarray, ranges: int, extra: np.ndarray | None) -> np.ndarray:
    """What is sent of a hash besides its range: 32 bits for an anchor, 64 for a window to be confirmed."""
    return h.astype(np.uint32) if extra is None else extra


class _Batch:
    """Windows of some documents: one entry per distinct hash, and what repeats inside the batch."""

    def __init__(self, ranges: int, wide: bool) -> None:
        self.ranges, self.wide = ranges, wide
        self.rows: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.extra: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []
        self.words = 0

    def add(self, row: int, h: np.ndarray, block: np.ndarray | None, extra: np.ndarray | None) -> None:
        self.rows.append(row)
        self.hashes.append(h)
        self.words += len(h)
        if self.wide:
            self.extra.append(extra)
        else:
            self.blocks.append(block)

    def full(self) -> bool:
        return self.words >= BATCH_WORDS or len(self.rows) >= BATCH_DOCS

    def flush(self, uid: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(group, batch, kind, data): kind 0 has entries for a range; 1 the rows; 2 what repeats already, for this batch."""
        if not self.rows:
            return
        h = np.concatenate(self.hashes)
        doc = np.repeat(np.arange(len(self.rows), dtype=np.uint16), [len(x) for x in self.hashes])
        part = _range_of(h, self.ranges)
        value = np.concatenate(self.extra) if self.wide else h.astype(np.uint32)
        order = np.lexsort((value, part))
        part, value, doc = part[order], value[order], doc[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(value)))
        entry = doc[at].copy()
        if not self.wide:
            block = np.concatenate(self.blocks)[order].astype(np.uint16)
            entry |= np.where(np.maximum.reduceat(block, at) > 0, _IS_BLOCK, np.uint16(0)) if len(at) else entry
        entry |= np.where(count > 1, _REPEATS, np.uint16(0))
        # what a batch keeps for itself goes to a group apart, as many groups as ranges, spread by hash
        own = self.ranges + int(mixed(np.array([uid], np.uint64))[0] % np.uint64(max(64, self.ranges)))
        yield own, uid, 1, np.array(self.rows, np.int64).tobytes()
        again = np.repeat(count > 1, count)
        if again.any():
            yield own, uid, 2, _hits(doc[again], part[again], value[again])
        cuts = np.searchsorted(part[at], np.arange(self.ranges + 1))
        values = value[at]
        for p in np.flatnonzero(np.diff(cuts)):
            i, j = cuts[p], cuts[p + 1]
            yield int(p), uid, 0, np.int64(j - i).tobytes() + _planes(values[i:j]) + entry[i:j].tobytes()
        self.__init__(self.ranges, self.wide)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of sorted values, the highest of each first, which compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T[::-1]).tobytes()


def _unplaned(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n)[::-1].T).view(kind).ravel()


def _hits(doc: np.ndarray, part: np.ndarray, value: np.ndarray) -> bytes:
    """Distinct (document, hash), by document."""
    full = (part.astype(np.uint64) << np.uint64(32)) | value if value.dtype == np.uint32 else value
    order = np.lexsort((full, doc))
    doc, full = doc[order], full[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (full[1:] != full[:-1])
    doc, full = doc[keep], full[keep]
    return np.int64(len(doc)).tobytes() + doc.tobytes() + full.tobytes()


def _read_hits(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, np.uint16, n, 8), np.frombuffer(data, np.uint64, n, 8 + 2 * n)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    g, uid, kind, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(uid, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["g", "uid", "kind", "data"])


def _sender(ranges: int, wide: bool, windows):
    """A mapInArrow function: (row, text, ...) to packed entries. ``windows(batch, i)`` gives hashes, blocks, extra of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("repeats", _MEMO)
        uid = TaskContext.get().partitionId() << 24
        batch = _Batch(ranges, wide)
        for b in batches:
            for i, row in enumerate(b.column(0).to_pylist()):
                found = windows(b, i)
                if found is not None:
                    batch.add(row, *found)
                if batch.full():
                    yield _record(list(batch.flush(uid)))
                    uid += 1
        if batch.rows:
            yield _record(list(batch.flush(uid)))

    return run


def _match(ranges: int, wide: bool):
    """A grouped function over a hash range: which batches' documents have a hash that occurs elsewhere (by a block, if anchors)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        g = key[0].as_py()
        if g >= ranges:
            return table.select(["uid", "kind", "data"])
        kind = np.uint64 if wide else np.uint32
        values, entries, sources, uids = [], [], [], []
        for uid, data in zip(table.column("uid").to_pylist(), table.column("data"), strict=True):
            data = data.as_buffer().to_pybytes()
            n = int(np.frombuffer(data, np.int64, 1)[0])
            values.append(_unplaned(data[8 : 8 + n * np.dtype(kind).itemsize], n, kind))
            entries.append(np.frombuffer(data, np.uint16, n, 8 + n * np.dtype(kind).itemsize))
            sources.append(np.full(n, len(uids), np.uint32))
            uids.append(uid)
        value, entry, source = np.concatenate(values), np.concatenate(entries), np.concatenate(sources)
        del values, entries, sources
        order = np.argsort(value, kind="stable")
        value, entry, source = value[order], entry[order], source[order]
        at, count = _runs(value)
        good = count > 1
        if not wide:
            good &= np.maximum.reduceat(entry & _IS_BLOCK, at) > 0
        mine = np.repeat(good, count) & ((entry & _REPEATS) == 0)
        value, entry, source = value[mine], entry[mine] & _DOC, source[mine]
        by = np.argsort(source, kind="stable")
        value, entry, source = value[by], entry[by], source[by]
        at, count = _runs(source)
        out = [_hits(entry[a : a + c], np.full(c, g, np.uint32), value[a : a + c]) for a, c in zip(at, count, strict=True)]
        return pa.table({"uid": pa.array([uids[source[a]] for a in at], pa.int64()), "kind": pa.array([2] * len(out), pa.int32()), "data": pa.array(out, pa.binary())})

    return run


def _gather(key: tuple, table: pa.Table) -> pa.Table:
    """A grouped function over a batch: the row and all hashes of each of its documents that has any."""
    rows, docs, values = None, [], []
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
        data = data.as_buffer().to_pybytes()
        if kind == 1:
            rows = np.frombuffer(data, np.int64)
        else:
            d, v = _read_hits(data)
            docs.append(d), values.append(v)
    if not docs:
        return pa.table({"__row": pa.array([], pa.int64()), "hits": pa.array([], pa.binary())})
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    at, count = _runs(doc)
    return pa.table({"__row": pa.array(rows[doc[at]], pa.int64()), "hits": pa.array([value[a : a + c].tobytes() for a, c in zip(at, count, strict=True)], pa.binary())})


def _matched(sent: DataFrame, ranges: int, wide: bool) -> DataFrame:
    """(__row, hits) of the documents whose entries in ``sent`` are matched."""
    answered = sent.groupBy("g").applyInArrow(_match(ranges, wide), "uid long, kind int, data binary")
    hits = answered.groupBy("uid").applyInArrow(_gather, "__row long, hits binary")
    # Rows that repeat a row have the same hashes.
    return hits.groupBy("__row").agg(F.max("hits").alias("hits"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256."""
    spark = docs.sparkSession
    block = (window + 1) // 2
    kind = docs.schema[doc_id].dataType.simpleString()
    deal = partitions(spark)
    ranges = max(4 * deal, -(-text_bytes(docs, text) // RANGE_BYTES))
    source = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("__row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def rolling(b: pa.RecordBatch, i: int):
        words = _words(b.column(1)[i].as_py())
        if len(words) < window:
            return None
        h = window_hashes(word_array(words, _MEMO), block)
        return h, np.arange(len(h)) % block == 0, None

    anchors = _matched(source.select("__row", "text").mapInArrow(_sender(ranges, False, rolling), _PASSED), ranges, False)

    dealt = source.repartition(deal, "__row")

    def around(b: pa.RecordBatch, i: int):
        """The windows that hold an anchor at a place that all their occurrences share."""
        w = word_array(_words(b.column(1)[i].as_py()), _MEMO)
        h = window_hashes(w, block)
        code = (_range_of(h, ranges).astype(np.uint64) << np.uint64(32)) | h.astype(np.uint32)
        anchor = np.isin(code, np.frombuffer(b.column(3)[i].as_py(), np.uint64))
        before = np.concatenate(([0], np.cumsum(anchor)))
        last = len(w) - window + 1
        inner = window - block + 1
        at = np.flatnonzero(before[inner : inner + last] > before[:last])
        if not len(at):
            return None
        return window_hashes(w, window)[at], None, window_hashes(w, window, 0xD1342543DE82EF95)[at]

    found = dealt.join(anchors, "__row").select("__row", "text", "doc_id", "hits")
    repeats = _matched(found.mapInArrow(_sender(ranges, True, around), _PASSED), ranges, True)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("repeats", _MEMO)
        for b in batches:
            total, gone, digest = [], [], []
            for t, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = _words(t)
                total.append(len(words))
                if hits is None or len(words) < window:
                    gone.append(0)
                else:
                    h = window_hashes(word_array(words, _MEMO), window, 0xD1342543DE82EF95)
                    at = np.flatnonzero(np.isin(h, np.frombuffer(hits, np.uint64)))
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    keep = np.cumsum(change[:-1]) == 0
                    gone.append(int(len(words) - keep.sum()))
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return dealt.join(repeats, "__row", "left").select("doc_id", "text", "hits").mapInArrow(removed, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")
