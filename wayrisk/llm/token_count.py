"""Exact token counts, with a whole-token shortcut for pieces that encode alone as one token.

A BPE with byte fallback joins two neighbours only if their concatenation is a vocabulary piece. A
text can thus be cut wherever no piece can span the cut, and its count is the sum over the parts.
``cut_proof`` proves, from the vocabulary file alone, that no piece has a space mark after another
character, so every cut before a run of spaces is safe. ``shortcut`` proves offline, by encoding each
candidate, which vocabulary strings encode alone as exactly one token. Counting then looks up each
pre-token (a run of spaces and the word after it) among those, counts matches as one directly, and
merges only the rest, remembering their counts in a bounded memo.

Defined results: null and empty texts have no tokens; texts of any length are counted whole, in
pre-tokens; an empty table gives an empty result; rows are independent, so repeated rows repeat their
result; columns other than the two named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wayrisk.llm._shared import MEMO, remember

SPACE = "▁"
#: A pre-token: its leading spaces and what follows up to the next space.
_PRETOKEN = re.compile(r" *[^ ]+| +")
_READY: dict[str, PieceCounts] = {}


def cut_proof(pieces: list[str]) -> None:
    """Raise unless no piece has a space mark after another character."""
    bad = [p for p in pieces if re.search(f"[^{SPACE}]{SPACE}", p)]
    if bad:
        raise ValueError(f"pieces span a word's start, so texts can't be cut there: {bad[:3]}")


def shortcut(model) -> set[str]:
    """Pre-tokens (as they stand in a text after its first word) that encode alone as one token."""
    own = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    words = [p[1:] for p in own if p.startswith(SPACE) and SPACE not in p[1:] and len(p) > 1]
    return {" " + w for w, ids in zip(words, model.encode(words), strict=True) if len(ids) == 1}


class PieceCounts(dict):
    """Tokens of each pre-token; the proven ones are there from the start, others are merged once and remembered."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        cut_proof([self.model.id_to_piece(i) for i in range(self.model.get_piece_size())])
        if [self.model.id_to_piece(i) for i in self.model.encode("  a")] != [SPACE * 2, SPACE + "a"]:
            raise ValueError("this model's spaces aren't kept as they are with one put in front")
        if self.model.is_unknown(self.model.piece_to_id(SPACE)):
            raise ValueError("this model has no piece for a space")
        self.proven = dict.fromkeys(shortcut(self.model), 1) | {" ": 1}
        super().__init__(self.proven)

    def clear(self) -> None:
        super().clear()
        self.update(self.proven)

    def __missing__(self, pretoken: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        # The library puts a space in front of each text; a pre-token brings its own.
        n = self[pretoken] = len(self.model.encode(pretoken[1:]))
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        # the library writes spaces as space marks, so that a mark in a text is like a space
        return sum(map(self.__getitem__, _PRETOKEN.findall(" " + text.replace(SPACE, " "))))


def count_tokens(docs: DataFrame, model_path: str, limit: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    ``model_path`` is a sentencepiece BPE file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _READY:
            _READY[model_path] = PieceCounts(model_path)
        counts = _READY[model_path]
        remember("tokens", counts)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = [counts.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
