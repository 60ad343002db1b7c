"""A quality classifier over supervised subword embeddings.

Words (between white space, case kept) and their character n-grams are hashed into buckets, each
with a learned vector; a document is the average of its features' vectors, and a softmax layer over
it gives the probability of label 1. Vectors and layer are trained together by stochastic gradient
descent in numpy, on a bounded sample of labelled documents. Since the layer is linear, scoring needs
one number a bucket, and a word's features add up to one number that is remembered.

Training sample: at most ``SAMPLE`` labelled documents, those whose ids hash lowest; only that sample
reaches the driver, as feature counts.

Defined results: null and empty texts have no features and get the layer's bias; without any labelled
row nothing can be rejected and each score is 1; null labels are not learnt from; an id counts once for
each label, with one text should it have several; texts are scored whole; an empty table gives an empty result; columns
other than those named are not read, and others pass through ``keep_good``.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.llm._shared import MEMO, remember

BUCKETS = 1 << 17
GRAMS = (2, 3, 4)
DIM = 16
#: Labelled documents to learn from, at most.
SAMPLE = 2_000
EPOCHS, RATE = 8, 0.6
ACCEPT = 0.7
_READY: dict[str, WordScores] = {}


def features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, with marks at its ends."""
    marked = f"<{word}>"
    parts = [marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))]
    return [xxhash.xxh3_64_intdigest(p.encode()) % BUCKETS for p in parts]


def document(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    counts: Counter = Counter()
    for word, n in Counter((text or "").split()).items():
        for f in features(word):
            counts[f] += n
    return np.fromiter(counts.keys(), np.int32, len(counts)), np.fromiter(counts.values(), np.float32, len(counts))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias) such that sigmoid(average score + bias) is the probability of label 1."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    done, total = 0, max(1, EPOCHS * len(samples))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(samples)):
            at, n, label = samples[k]
            rate = RATE * (1 - done / total)
            done += 1
            share = n / n.sum() if len(n) else n
            hidden = share @ vectors[at] if len(n) else np.zeros(DIM, np.float32)
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[label] -= 1
            back = error @ layer
            layer -= rate * np.outer(error, hidden).astype(np.float32)
            bias -= rate * 0.1 * error
            if len(n):
                vectors[at] -= rate * share[:, None] * back[None, :] * len(n) ** 0.5
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0])


class WordScores(dict):
    """(sum of its features' scores, number of features) of each word."""

    def __init__(self, scores: np.ndarray, bias: float) -> None:
        super().__init__()
        self.scores, self.bias = scores, bias

    def __missing__(self, word: str) -> complex:
        if len(self) >= MEMO:
            self.clear()
        f = features(word)
        # both sums in one number
        out = self[word] = complex(float(self.scores[f].sum()), len(f))
        return out

    def score(self, text: str | None) -> float:
        z = sum(map(self.__getitem__, (text or "").split()), 0j)
        x = (z.real / z.imag if z.imag else 0.0) + self.bias
        return float(1 / (1 + np.exp(-x)))


def fit(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> tuple[np.ndarray, float] | None:
    """The model, from ``labelled`` (doc_id, label 0 or 1) and the texts of ``docs``; None without any label."""
    chosen = labelled.where("label in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("label").cast("int").alias("label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "label").limit(sample)  # bounded, so it may be broadcast
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(chosen), "__id")
    # one text for each, however often an id occurs in the corpus
    rows = rows.groupBy("__id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [document(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([n.tobytes() for _, n in got], pa.binary())], names=["id", "label", "at", "n"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    got = rows.select("__id", "label", "text").mapInArrow(counted, f"id {kind}, label int, at binary, n binary").collect()
    got = sorted(got, key=lambda r: (r.id, r.label, r.at))
    return train([(np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.float32), r.label) for r in got]) if got else None


def score_udf(docs: DataFrame, model: tuple[np.ndarray, float] | None):
    """A function of a text column: the probability of label 1."""
    if model is None:
        return lambda column: F.lit(1.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed half megabyte
    name = uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if name not in _READY:
            _READY.clear()
            _READY[name] = WordScores(*shared.value)
        scores = _READY[name]
        remember("quality", scores)
        return pd.Series([scores.score(t) for t in texts], dtype="float64")

    return score


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", accept: float = ACCEPT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. ``labels`` has doc_id and quality."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label")), text=text, doc_id=doc_id)
    out = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), score_udf(docs, model)(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label")), text=text, doc_id=doc_id)
    return docs.where(score_udf(docs, model)(F.col(text)) >= accept)
