"""Language identification by cross-parsing entropy over suffix automata.

Labelled running text of each language becomes a suffix automaton. A document, lower-cased and with each run
of white space as one blank, is one string, cut from the left into the longest phrases that occur in a
language's text, across words (a character that does not occur is a phrase of its own). Phrases times the
logarithm of the labelled text's length estimate the cross entropy; the language whose text needs least wins.

All languages' automata are one table of next states and phrase ends, so that many documents take a step at a
time as arrays; the few longest finish one by one. Where alphabets are so large that the table would have over
``TABLE`` cells, all documents are parsed one by one.

Labelled text, a bounded sample: of each language, about ``SAMPLE`` documents are chosen by the hash of their ids, of copies
one. Each gives a passage of ``EXCERPT`` characters that begins at a hashed place of it, or all of it if it is shorter; as many
as ``LENGTH`` characters have room for, by hash, and at least one. Documents are parsed whole.

Defined results: null texts and texts without a letter are ``und`` with score 0; without labelled
rows every text is ``und``; ties go to the language that comes first by name; repeated rows repeat their result;
an empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.llm.quality import held_out

#: Labelled documents of a language, about; characters of each, and of all together, at most.
SAMPLE, EXCERPT, LENGTH = 200, 160, 24_000
#: Cells of the table of steps, at most, and documents that take steps together, at least.
TABLE, TOGETHER = 40_000_000, 40
_READY: dict[str, Parser] = {}


def plain(text: str) -> str:
    """Lower-cased, with each run of white space as one blank."""
    return " ".join(text.lower().split())


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``text``, from state 0: it accepts exactly the substrings."""
    steps: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(steps)
        steps.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return steps


def phrases(steps: list[dict[str, int]], text: str) -> int:
    """Longest-match phrases that ``text`` is cut into."""
    n, state = 0, 0
    for c in text:
        to = steps[state].get(c)
        if to is None:
            if state:
                n += 1
            to = steps[0].get(c)
            if to is None:
                n += 1
                to = 0
        state = to
    return n + (state > 0)


class Parser:
    """The automata of labelled texts, and the phrases that they cut documents into."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(texts)
        self.steps = [automaton(texts[x]) for x in self.langs]
        self.cost = np.array([math.log2(max(2, len(texts[x]))) for x in self.langs])
        alphabet = sorted(set("".join(texts.values())))
        self.width = len(alphabet) + 1
        self.code = np.zeros(0x110000, np.uint16)
        self.table = None
        if texts and self.width * sum(map(len, self.steps)) <= TABLE and self.width < 1 << 16:
            self.code[[ord(c) for c in alphabet]] = np.arange(1, self.width)
            self._tabulate({c: k for k, c in enumerate(alphabet, 1)})

    def _tabulate(self, code: dict[str, int]) -> None:
        """table[state + character's code] = next state << 2 | phrases that end before it; states are rows' starts, language after language."""
        self.start, parts, base = [], [], 0
        for steps in self.steps:
            root = np.zeros(self.width, np.int64)
            for c, to in steps[0].items():
                root[code[c]] = to
            # without a step, a phrase ends and the root goes on; without one there, the character is a phrase
            to = np.tile(root, (len(steps), 1))
            ends = np.tile(1 + (root == 0), (len(steps), 1))
            ends[0] = root == 0
            for s, own in enumerate(steps):
                at = [code[c] for c in own]
                to[s, at], ends[s, at] = list(own.values()), 0
            parts.append(((base + to * self.width) << 2 | ends).astype(np.int32).ravel())
            self.start.append(base)
            base += to.size
        self.table = np.concatenate(parts)
        self.start = np.array(self.start, np.int32)

    def _whole(self, codes: np.ndarray, state: list[int], n: list[int]) -> list[int]:
        """The phrases of the rest of a document after those so far."""
        table, out, codes = memoryview(self.table), [], codes.tolist()
        for s, k, first in zip(state, n, self.start.tolist(), strict=True):
            for c in codes:
                v = table[s + c]
                k += v & 3
                s = v >> 2
            out.append(k + (s != first))
        return out

    def phrases_of(self, texts: list[str]) -> np.ndarray:
        """A row of phrase counts, one for each language, for each of ``texts``."""
        if self.table is None:
            return np.array([[phrases(s, t) for s in self.steps] for t in texts], np.int64).reshape(len(texts), len(self.langs))
        codes = [self.code[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] for t in texts]
        length = np.array([len(c) for c in codes], np.int64)
        order = np.argsort(-length, kind="stable")
        flat = np.concatenate([codes[i] for i in order]) if len(codes) else np.zeros(0, np.uint16)
        length = length[order]
        at = np.cumsum(length) - length
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        state = np.tile(self.start, (len(texts), 1))
        # so many documents still have a character at a place
        for place, live in enumerate(_longer(length)):
            v = self.table[state[:live] + flat[at[:live] + place][:, None]]
            out[:live] += v & 3
            np.right_shift(v, 2, out=state[:live])
        out += state != self.start
        done = len(_longer(length))
        for k in np.flatnonzero(length > done):
            out[k] = self._whole(flat[at[k] + done : at[k] + length[k]], state[k].tolist(), (out[k] - (state[k] != self.start)).tolist())
        back = np.empty_like(out)
        back[order] = out
        return back

    def languages(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        out = [("und", 0.0)] * len(texts)
        bits = self.phrases_of([plain(texts[i]) for i in known]) * self.cost if known else np.zeros((0, 0))
        for i, b in zip(known, bits.tolist(), strict=True):
            least = min(b)
            # a code that is n bits shorter is 2**n times as likely
            out[i] = self.langs[b.index(least)], 1 / sum(2.0 ** max(-1000.0, least - x) for x in b)
        return out


def _longer(length: np.ndarray) -> np.ndarray:
    """How many of the falling lengths are over 0, 1, 2 ..., while at least ``TOGETHER`` are."""
    if len(length) < TOGETHER:
        return np.zeros(0, np.int64)
    return np.searchsorted(-length, -np.arange(length[TOGETHER - 1]), side="left")


def learn(docs: DataFrame, sample: int = SAMPLE, excerpt: int = EXCERPT, most: int = LENGTH, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, str]:
    """Labelled running text of each language that ``docs`` names outside the held-out rows."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out(F.col(doc_id)), F.lit(True)))
    known = known.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return {}
    resolution = 1 << 40
    place = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(resolution))
    chosen = F.lit(False)
    for name, n in counts.items():
        chosen |= (F.col("lang") == name) & (place < int(min(1.0, sample / n) * resolution))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - excerpt + 1, F.lit(1))).cast("int") + 1
    # copies say nothing new; the sample of a language is small, so it meets in one task and what fits in the driver
    rows = known.where(chosen).select("lang", place.alias("place"), F.substr("text", start, F.lit(excerpt)).alias("text"))
    order = Window.partitionBy("lang").orderBy("place", "text")
    rows = rows.groupBy("lang", "text").agg(F.min("place").alias("place")).select("lang", "text", "place", F.row_number().over(order).alias("nth"), F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("filled"))
    texts: dict[str, list[str]] = {name: [] for name in counts}
    for r in rows.where((F.col("filled") <= most) | (F.col("nth") == 1)).orderBy("lang", "nth").collect():
        texts[r.lang].append(r.text)
    return {name: f" {plain(' '.join(parts))} " for name, parts in texts.items()}


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text=text, lang=lang, doc_id=doc_id))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _READY:
            _READY.clear()
            _READY[name] = Parser(shared.value)
        known = _READY[name]
        for b in batches:
            got = known.languages(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
