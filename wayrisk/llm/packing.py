"""Packing of token sequences by non-negative least squares over a length histogram.

1. Each document is tokenised once (pre-tokens between ASCII blanks encode independently and are
   memoised). Every full window of a document is a sequence of its own; what is left has a length
   below the window, and lengths fall into bins of equal width.
2. The histogram of bins, a table of fixed size, goes to the driver. There all combinations of up
   to three bins that fill the window are enumerated, and non-negative least squares finds how often
   to use each, so that together they use up the histogram. Counts are rounded and held to
   what each bin still has.
3. Which pieces take which slot follows from a piece's rank in its bin, found with salted two-level
   ranks, so that no task holds a whole bin, and from a broadcast table of slot ranges, whose size
   the number of combinations in use bounds.
4. Residuals are packed greedily: they are laid end to end and cut where a window is full, so that
   all their sequences but the last are full. Only the documents that are cut are tokenised again,
   for the checksums of their parts.

Defined results: a null or empty text is the closing id alone; a text of any length is tokenised
whole; an empty table gives an empty result; repeated rows are packed each for itself, and null ids
are kept as null; columns other than the two named are not read. Sequence ids are unique
but not dense; offsets in a sequence run from 0 without gaps.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.llm._shared import checkpoint, remember

WINDOW = 4096
#: Width of a length bin: a piece in a slot leaves at most one less than this unused.
BIN = 16
#: Combinations have at most this many pieces.
DEPTH = 3
#: Rows that one salt of a bin should hold.
SALT_ROWS = 50_000
#: Entries that a worker remembers of words, and of pre-tokens and words of other characters: two workers of an executor have room for them.
MEMO, FEW = 300_000, 150_000
_BLANK = re.compile(r"[ \n\t\r]+")
_READY: dict[str, WordIds] = {}


#: Characters whose normal form, lower case and kind the fast path knows: printable ASCII and Latin letters.
_KNOWN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0152\u0153]+")
#: Other characters whose lower case is among them.
_LOWER_TO_KNOWN = ('\u0178', '\u1e9e', '\u212a', '\u212b')
_LETTER = "a-z\u00df-\u00f6\u00f8-\u00ff\u0153"
#: The tokenizer's own pre-tokens, over those characters.
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next one over 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pretokens(dict):
    """The ids of each pre-token, as little-endian unsigned 32-bit integers, straight from the merges."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, pretoken: str) -> bytes:
        if len(self) >= FEW:
            self.clear()
        text = pretoken if pretoken.isascii() else "".join(map(self.letters.__getitem__, pretoken.encode()))
        ids = [t.id for t in self.model.tokenize(text)]
        out = self[pretoken] = struct.pack(f"<{len(ids)}I", *ids)
        return out


class PlainIds(dict):
    """The ids of each word (bytes, lower-cased) of known characters; None for any other word."""

    def __init__(self, pretokens: Pretokens) -> None:
        super().__init__()
        self.pretokens = pretokens

    def __missing__(self, word: bytes) -> bytes | None:
        if len(self) >= MEMO:
            self.clear()
        text = word.decode()
        plain = _KNOWN.fullmatch(text) and "<|" not in text
        out = self[word] = b"".join(map(self.pretokens.__getitem__, _PRETOKEN.findall(text))) if plain else None
        return out


class WordIds(dict):
    """The ids of each word between ASCII blanks, as little-endian unsigned 32-bit integers.

    Exact only for a tokenizer that never joins across white space, lower-cases and splits words as ``_PRETOKEN`` does;
    ``check`` makes sure of it. A text is lower-cased and split as a whole; where it has words of other
    characters or with a special token, it is split as it is, and those words go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.pretokens = Pretokens(self.tokenizer.model)
        self.plain = PlainIds(self.pretokens)
        self.check()

    def check(self) -> None:
        known = "".join(map(chr, (*range(33, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100), 0x152, 0x153)))
        for text in ("a b", " a\tb\n", "x's  'S <|endoftext|> y\r\n!? .", "é ́a", known, " ".join(known), "Don't we'LL 12ab!!?? œuvre's ÀÉß&&&", *_LOWER_TO_KNOWN):
            if self.ids(text) != self.whole(text):
                raise ValueError("this tokenizer joins or marks white space, or splits words otherwise: its words can't be encoded apart")

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= FEW:
            self.clear()
        if _KNOWN.fullmatch(word) and "<|" not in word:
            out = b"".join(map(self.pretokens.__getitem__, _PRETOKEN.findall(word.lower())))
        else:
            out = self.whole(word)
        self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        if "\x0b" not in text and "\x0c" not in text:  # blanks for split(), but not for the tokenizer
            try:
                return b"".join(map(self.plain.__getitem__, text.lower().encode().split()))
            except TypeError:  # some word isn't plain
                pass
        return b"".join(map(self.__getitem__, filter(None, _BLANK.split(text))))


def _encoder(path: str) -> WordIds:
    if path not in _READY:
        _READY[path] = WordIds(path)
    words = _READY[path]
    remember("packing", words, words.plain, words.pretokens)
    return words


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Ascending tuples of up to ``depth`` numbers from 1 that add up to ``units``, without the single one."""
    out = []

    def extend(head: tuple[int, ...], left: int) -> None:
        low = head[-1] if head else 1
        if head and left >= low:
            out.append((*head, left))
        if len(head) + 2 <= depth:
            for x in range(low, left // 2 + 1):
                extend((*head, x), left - x)

    extend((), units)
    return list(dict.fromkeys(out))


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """Lawson and Hanson's active set method: x >= 0 that minimises |ax - b|, through the normal equations."""
    gram, right = a.T @ a, a.T @ b
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    limit = tolerance * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(3 * n + 10):
        gain = np.where(passive, -np.inf, right - gram @ x)
        best = int(gain.argmax())
        if gain[best] <= limit:
            break
        passive[best] = True
        while True:
            p = np.flatnonzero(passive)
            s = np.linalg.lstsq(gram[np.ix_(p, p)], right[p], rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[p] = s
                break
            low = s <= 0
            step = np.min(x[p][low] / np.maximum(x[p][low] - s[low], 1e-300))
            x[p] += step * (s - x[p])
            drop = p[x[p] <= 1e-12 * max(1.0, x.max())]
            x[drop] = 0
            passive[drop] = False
            if not passive.any():
                break
    return x


def plan(histogram: dict[int, int], units: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) by rounded least squares, within what each bin has."""
    h = np.zeros(units + 1)
    for k, v in histogram.items():
        h[k] = v
    combos = [c for c in combinations(units) if all(h[x] for x in c)]
    if not combos:
        return []
    scale = h.max()
    # Greedily reduce the candidates to a few hundred that can carry the most weight, keeping every bin's best.
    can = np.array([min(h[x] / c.count(x) for x in c) for c in combos])
    order = np.argsort(-can, kind="stable")
    taken, uses = [], np.zeros(units + 1, int)
    for i in order:
        if any(uses[x] < 6 for x in combos[i]):
            taken.append(i)
            for x in set(combos[i]):
                uses[x] += 1
    combos = [combos[i] for i in taken]
    a = np.zeros((units + 1, len(combos)))
    for j, c in enumerate(combos):
        for x in c:
            a[x, j] += 1
    # Long pieces are harder to place later: their misfit weighs more.
    weight = np.sqrt(np.arange(units + 1) / units)[:, None]
    repeats = nnls(a * weight, h / scale * weight[:, 0]) * scale
    left, out = h.astype(np.int64), []
    for j in np.argsort(-repeats, kind="stable"):
        c = combos[j]
        n = min(round(repeats[j]), *(int(left[x]) // c.count(x) for x in c))
        if n > 0:
            for x in c:
                left[x] -= n
            out.append((c, n))
    return out


def _slots(chosen: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple], int]:
    """(bin, from rank, to rank, first sequence, slot) of each slot, and the number of sequences."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for c, n in chosen:
        for slot, x in enumerate(c):
            at = rank.get(x, 0)
            rows.append((x, at, at + n, sequence, slot))
            rank[x] = at + n
        sequence += n
    return rows, sequence


def _before(df: DataFrame, group: list[str], order: list[str], value: str) -> F.Column:
    """The sum of ``value`` over the rows before this one, in its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")


def _ranked(df: DataFrame, value: str, out: str, salts: int) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same __bin before this one.

    Sums of each (bin, salt) are added up over the salts of a bin, a table of ``salts`` rows a bin; rows
    are added up only within their salt.
    """
    sums = df.groupBy("__bin", "__salt").agg(F.sum(value).alias("__of"))
    sums = sums.withColumn("__base", _before(sums, ["__bin"], ["__salt"], "__of")).drop("__of")
    near = df.withColumn("__near", _before(df, ["__bin", "__salt"], ["__row", "__n"], value))
    return near.join(sums, ["__bin", "__salt"]).withColumn(out, F.col("__near") + F.col("__base")).drop("__near", "__base")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer_path`` is a file for the tokenizers library that every executor can open.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    end = struct.pack("<I", end_id)
    source = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("__row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path).ids
        step = 4 * window
        for b in batches:
            n, crcs = [], []
            for t in b.column(2).to_pylist():
                ids = encode(t or "") + end
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + step]) for i in range(0, len(ids), step)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["__row", "doc_id", "__n", "__crcs"])

    sized = checkpoint(source.mapInArrow(tokenised, f"__row bigint, doc_id {kind}, __n bigint, __crcs array<bigint>"))

    units = window // BIN
    left = F.col("__n") % window
    sized = sized.withColumn("__full", F.floor(F.col("__n") / window).cast("long"))
    binned = sized.withColumn("__bin", F.ceil(left / BIN).cast("int"))
    histogram = {r[0]: (r[1], r[2]) for r in binned.groupBy("__bin").agg(F.count(F.lit(1)), F.sum("__full")).collect()}
    total = sum(c for c, _ in histogram.values())
    salts = max(8, -(-total // SALT_ROWS))
    chosen = plan({k: c for k, (c, _) in histogram.items() if 0 < k < units}, units)
    slots, n_combined = _slots(chosen)
    n_full = sum(f for _, f in histogram.values())

    salt = F.pmod(F.xxhash64("__row", F.lit(1)), F.lit(salts)).cast("int").alias("__salt")
    # Full windows: a rank over the documents that have any, counted in windows.
    full = sized.where("__full > 0").select("*", F.lit(0).alias("__bin"), salt)
    full = _ranked(full, "__full", "__rank", salts)
    full = full.select("doc_id", F.col("__n").alias("doc_tokens"), "__rank", F.posexplode(F.slice("__crcs", 1, F.col("__full").cast("int"))).alias("__i", "ids_crc32"))
    full = full.select(
        "doc_id", (F.col("__i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("__rank") + F.col("__i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )

    # What is left of each document, and its rank in its bin.
    rest = binned.where(left > 0).select("__row", "doc_id", "__n", left.alias("__left"), F.element_at("__crcs", -1).alias("__crc"), "__bin", salt, F.lit(1).alias("__one"))
    rest = _ranked(rest, "__one", "__rank", salts)
    where = spark.createDataFrame(slots, "__sbin int, __from long, __to long, __first long, __slot int")
    placed = rest.join(F.broadcast(where), (F.col("__bin") == F.col("__sbin")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")), "left")
    placed = checkpoint(placed.drop("__sbin", "__to", "__one"))

    start = F.col("__n") - F.col("__left")
    combined = placed.where(F.col("__first").isNotNull()).withColumn("sequence_id", n_full + F.col("__first") + F.col("__rank") - F.col("__from"))
    combined = combined.withColumn("offset", _before(combined, ["sequence_id"], ["__slot"], "__left"))
    combined = combined.select("doc_id", start.alias("start"), F.col("__left").alias("length"), F.col("__crc").alias("ids_crc32"), F.col("__n").alias("doc_tokens"), "sequence_id", "offset")

    # Residuals end to end, each cut where a window is full.
    residual = placed.where(F.col("__first").isNull()).drop("__rank", "__from", "__first", "__slot").withColumn("__bin", F.lit(0))
    residual = checkpoint(_ranked(residual, "__left", "__at", salts))
    base = n_full + n_combined
    sequence, offset = F.floor(F.col("__at") / window).cast("long"), F.col("__at") % window
    room = window - offset
    whole = residual.where(F.col("__left") <= room).select("doc_id", start.alias("start"), F.col("__left").alias("length"), F.col("__crc").alias("ids_crc32"), F.col("__n").alias("doc_tokens"), (base + sequence).alias("sequence_id"), offset.alias("offset"))
    cut = residual.where(F.col("__left") > room).select("__row", "doc_id", "__n", start.alias("__start"), room.alias("__head"), sequence.alias("__seq"), offset.alias("__offset"))

    wanted = cut.select("__row", "__start", "__head", "__n").distinct()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path).ids
        for b in batches:
            row, at, head, texts = (b.column(i).to_pylist() for i in range(4))
            crc = []
            for a, h, t in zip(at, head, texts, strict=True):
                ids = encode(t or "") + end
                crc.append((zlib.crc32(ids[4 * a : 4 * (a + h)]), zlib.crc32(ids[4 * (a + h) :])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(at, pa.int64()), pa.array(head, pa.int64()), pa.array([x for x, _ in crc], pa.int64()), pa.array([x for _, x in crc], pa.int64())],
                names=["__row", "__start", "__head", "__crc1", "__crc2"],
            )

    # One document for each request, should a row be there more than once.
    again = source.join(wanted, "__row").select("__row", "__start", "__head", "text")
    again = again.mapInArrow(parts, "__row bigint, __start bigint, __head bigint, __crc1 bigint, __crc2 bigint").distinct()
    cut = cut.join(again, ["__row", "__start", "__head"])
    end_of_first = F.col("__start") + F.col("__head")
    two = F.array(
        F.struct(F.col("__start").alias("start"), F.col("__head").alias("length"), F.col("__crc1").alias("ids_crc32"), F.col("__seq").alias("seq"), F.col("__offset").alias("offset")),
        F.struct(end_of_first.alias("start"), (F.col("__n") - end_of_first).alias("length"), F.col("__crc2").alias("ids_crc32"), (F.col("__seq") + 1).alias("seq"), F.lit(0).cast("long").alias("offset")),
    )
    cut = cut.select("doc_id", F.col("__n").alias("doc_tokens"), F.inline(two)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (base + F.col("seq")).alias("sequence_id"), "offset")
    return full.unionByName(combined).unionByName(whole).unionByName(cut)
