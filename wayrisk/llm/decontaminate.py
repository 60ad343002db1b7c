"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

The index is inverted: each term has the items that hold it, in order, with their BM25 impacts as
shares of the item's score against itself, and the largest impact of each block of items. Every
passage of every training text (half-overlapping windows, so that any item of up to half a window
lies within one) is a query, and all items that score at least ``THRESHOLD`` are retrieved by
block-max WAND. A bound over whole texts at once goes first: terms are split so that no item reaches the threshold on
common terms alone, and only passages whose other terms, with the largest share that the common ones
could add, reach it for some block are queried at all; nothing that could score is passed over.
A retrieved item is verified by the overlap of its question and of its answer: the share of each one's
five-word shingles near the passage.

The index is broadcast, for at most ``INDEX_BYTES`` of item texts at a time; a larger set is taken in blocks of
items, each against all documents. What scores depend on (the number of items, document frequencies, mean length and the
length of a passage) is counted over all items once and given to each block, so blocks change no result.

Defined results: words are runs of letters, digits and underscores, lower-cased; an item's answer is its
last sentence, or the last third of its words if it has but one; null or empty items and texts match
nothing; items of one text are all found; texts are queried whole; repeated rows repeat their result;
empty tables give an empty result; other columns pass through ``keep_clean``.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk.llm._shared import checkpoint

#: Least BM25 score of a passage, as a share of the item's score against itself.
THRESHOLD = 0.6
#: Least share of the question's and of the answer's shingles.
OVERLAP = 0.75
SHINGLE = 5
#: Passages start so many words apart, or so many as the longest item has, and are twice as long.
STRIDE = 64
#: Items in a block of a posting list.
BLOCK = 4
K1, B = 1.2, 0.75
#: Bytes of item texts that one index may hold.
INDEX_BYTES = 16_000_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_READY: dict[str, Index] = {}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and answer."""
    parts = [w for w in map(words_of, _SENTENCE.split(text.strip())) if w]
    if len(parts) > 1:
        return [x for p in parts[:-1] for x in p], parts[-1]
    w = parts[0] if parts else []
    cut = len(w) - max(1, len(w) // 3)
    return (w[:cut], w[cut:]) if cut else (w, w)


def overlap(part: list[str], region: list[str]) -> float:
    """Share of the shingles of ``part`` that ``region`` has."""
    n = min(SHINGLE, len(part))
    mine = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
    there = {tuple(region[i : i + n]) for i in range(len(region) - n + 1)}
    return len(mine & there) / len(mine) if mine else 0.0


class Corpus:
    """What BM25 needs of all items: their number, total and largest length, and the items that hold each term."""

    def __init__(self, n: int, words: int, longest: int, df: dict[str, int]) -> None:
        self.n, self.words, self.longest, self.df = n, words, longest, df

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Corpus:
        each = [w for _, t in items if (w := words_of(t))]
        return cls(len(each), sum(map(len, each)), max(map(len, each), default=0), Counter(t for w in each for t in set(w)))


class Index:
    """An inverted index of items [(item_id, text)] of ``corpus`` (by default these items alone) with block maxima."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, corpus: Corpus | None = None) -> None:
        self.threshold = threshold
        corpus = corpus or Corpus.of(items)
        kept = [(i, t, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _, _ in kept]
        self.texts = [t for _, t, _ in kept]
        self.words = [w for _, _, w in kept]
        n, df = corpus.n, corpus.df
        self.stride = max(STRIDE, corpus.longest)
        self.n_blocks = -(-len(kept) // BLOCK)
        self.term = {t: k for k, t in enumerate(sorted({t for w in self.words for t in w}))}
        mean = corpus.words / n if n else 1.0
        postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for item, w in enumerate(self.words):
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in Counter(w).items()}
            whole = sum(raw.values())
            for t, x in raw.items():
                postings[self.term[t]].append((item, x / whole))
        self.docs = [[d for d, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.largest = [max(x) for x in self.impacts]
        self.block_max: list[dict[int, float]] = []
        for p in postings:
            most: dict[int, float] = {}
            for d, x in p:
                most[d // BLOCK] = max(most.get(d // BLOCK, 0.0), x)
            self.block_max.append(most)
        self._split(len(kept))

    def _split(self, n: int) -> None:
        """Common terms, as many of the most frequent as leave each item short of the threshold; the rest's block maxima in flat arrays."""
        share, common = np.zeros(n), np.zeros(len(self.docs), bool)
        for t in sorted(range(len(self.docs)), key=lambda t: -len(self.docs[t])):
            if len(self.docs[t]) < 3:
                break
            if all(share[d] + x < 0.5 * self.threshold for d, x in zip(self.docs[t], self.impacts[t], strict=True)):
                share[self.docs[t]] += self.impacts[t]
                common[t] = True
        self.common_in_block = np.array([share[b * BLOCK : (b + 1) * BLOCK].max() for b in range(self.n_blocks)]) if n else np.zeros(0)
        blocks, most, start = [], [], [0]
        for t, by in enumerate(self.block_max):
            if not common[t]:
                blocks += by.keys()
                most += by.values()
            start.append(len(blocks))
        self.flat_blocks, self.flat_most, self.flat_start = np.array(blocks, np.int64), np.array(most), np.array(start)
        self.rare = {w: t for w, t in self.term.items() if not common[t]}

    def retrieve(self, terms: set[int]) -> list[tuple[int, float]]:
        """(item, score) of all items that score at least the threshold against distinct ``terms``: block-max WAND."""
        # a cursor: [current item, place, term]
        cursors = [[self.docs[t][0], 0, t] for t in terms]
        least, end, out = self.threshold - 1e-9, len(self.ids), []

        def move(c: list, to: int) -> None:
            docs = self.docs[c[2]]
            c[1] = bisect_left(docs, to, c[1])
            c[0] = docs[c[1]] if c[1] < len(docs) else end

        while True:
            cursors = [c for c in cursors if c[0] < end]
            cursors.sort()
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += self.largest[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_max[c[2]].get(block, 0.0) for c in cursors[: pivot + 1]) < least:
                # nothing before the block's end, or before the next cursor, can score
                to = min((block + 1) * BLOCK, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end)
                for c in cursors[: pivot + 1]:
                    move(c, max(to, item + 1) if c[0] <= item else to)
            elif cursors[0][0] == item:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= least:
                    out.append((item, score))
                for c in cursors[: pivot + 1]:
                    move(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    move(c, item)

    def passages(self, words: list[str]) -> np.ndarray:
        """Starts of the passages that could reach the threshold for some block of items."""
        rare = self.rare
        found = [(i, rare[w]) for i, w in enumerate(words) if w in rare]
        if not found:
            return np.zeros(0, np.int64)
        at, term = np.array(found, np.int64).T
        chunk, n_terms = at // self.stride, len(self.docs)
        pair = np.unique(np.concatenate((chunk, chunk[chunk > 0] - 1)) * n_terms + np.concatenate((term, term[chunk > 0])))
        passage, term = pair // n_terms, pair % n_terms
        first, n = self.flat_start[term], self.flat_start[term + 1] - self.flat_start[term]
        flat = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        cell, which = np.unique(np.repeat(passage, n) * self.n_blocks + self.flat_blocks[flat], return_inverse=True)
        bound = np.bincount(which, self.flat_most[flat]) + self.common_in_block[cell % self.n_blocks]
        return np.unique(cell[bound >= self.threshold - 1e-9] // self.n_blocks) * self.stride

    def matches(self, text: str | None) -> list[tuple[int, float, float, float, int, int]]:
        """(item id, score, question's and answer's overlap, first and last word of the passage), the best passage of each verified item."""
        words = words_of(text)
        best: dict[int, tuple] = {}
        for start in self.passages(words).tolist():
            end = min(len(words), start + 2 * self.stride)
            terms = {self.term[w] for w in set(words[start:end]) if w in self.term}
            for item, score in self.retrieve(terms):
                reach = len(self.words[item])
                region = words[max(0, start - reach) : end + reach]
                question, answer = question_answer(self.texts[item])
                q, a = overlap(question, region), overlap(answer, region)
                found = (score, q, a, start, end - 1)
                if q >= OVERLAP and a >= OVERLAP and (item not in best or (q + a, score) > (best[item][1] + best[item][2], best[item][0])):
                    best[item] = found
        return [(self.ids[i], *x) for i, x in sorted(best.items())]


def _indexes(docs: DataFrame, items: DataFrame, item_id: str, text: str) -> list[tuple[str, object]]:
    """(name, broadcast items and their corpus) of each block of items; each is bounded in bytes."""
    some = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    size = some.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    share = docs.sparkSession.sparkContext.broadcast
    if size <= INDEX_BYTES:
        rows = sorted((r.i, r.t) for r in some.collect())
        return [(uuid.uuid4().hex, share((rows, Corpus.of(rows))))] if rows else []
    n = -(-2 * size // INDEX_BYTES)

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    some = checkpoint(some.select("i", "t", split("t").alias("w"), F.pmod(F.xxhash64("i", "t"), F.lit(n)).alias("block")))
    total = some.where(F.size("w") > 0).agg(F.count(F.lit(1)), F.sum(F.size("w")), F.max(F.size("w"))).first()
    each = some.select("block", F.explode(F.array_distinct("w")).alias("term"))
    df = checkpoint(each.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    out = []
    for k in range(n):
        rows = sorted((r.i, r.t) for r in some.where(F.col("block") == k).select("i", "t").collect())
        if rows:
            mine = each.where(F.col("block") == k).select("term").distinct().join(df, "term").collect()
            out.append((uuid.uuid4().hex, share((rows, Corpus(*(x or 0 for x in total), {r.term: r.df for r in mine})))))
    return out


def _ready(name: str, shared) -> Index:
    if name not in _READY:
        if len(_READY) > 1:
            _READY.clear()
        rows, corpus = shared.value
        _READY[name] = Index(rows, corpus=corpus)
    return _READY[name]


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, score, question_overlap, answer_overlap, first_word, last_word."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, score double, question_overlap double, answer_overlap double, first_word bigint, last_word bigint"
    ids, item_ids = source.schema["doc_id"].dataType, items.schema[item_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(ids), to_arrow_type(item_ids), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "last_word"]
    out = None
    for name, shared in _indexes(docs, items, item_id, "text"):

        def run(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            index = _ready(name, shared)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in index.matches(t)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs`` without a verified item, with all their columns."""

    def clean_of(name, shared):
        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            index = _ready(name, shared)
            return pd.Series([not index.matches(t) for t in texts], dtype="bool")

        return clean

    for name, shared in _indexes(docs, items, item_id, "text"):
        docs = docs.where(clean_of(name, shared)(F.col(text)))
    return docs
