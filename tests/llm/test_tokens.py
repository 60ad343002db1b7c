"""Packing and token counts against the tokenizers' own libraries."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wayrisk.llm import packing, token_count

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_counts(docs, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t, *_ in rows}
    got = token_count.count_tokens(docs, PIECES, 400).where("doc_id is not null").collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (*want[r.doc_id], want[r.doc_id][1] > 400)


@pytest.mark.parametrize("alphabet", [" ab\n\t", " é　\u00a0▁x", "<s>/unk |"])
def test_count_any_text(alphabet):
    rng, counts = random.Random(5), token_count.PieceCounts(PIECES)
    for _ in range(300):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
        assert counts.count(t) == len(counts.model.encode(t)), repr(t)


def test_words_encode_apart():
    rng, ids = random.Random(6), packing.WordIds(WORDS)
    for _ in range(300):
        t = "".join(rng.choices(" \n\r\x1c\u00a0aZé ́ßŒ'st!<|1２Σς", k=rng.randint(0, 14)))
        assert ids.ids(t) == ids.whole(t), repr(t)


def check_packed(got, want):
    """Each id once, gapless sequences of at most 4096."""
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    covered = 0
    for r in got:
        ids = want[r.doc_id]
        part = ids[r.start : r.start + r.length]
        assert r.doc_tokens == len(ids) and len(part) == r.length and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
        covered += r.length
    return covered, len(sequences)


def test_packing(docs, rows):
    tokenizer = Tokenizer.from_file(WORDS)
    encode = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    want = {i: encode(t) for i, t, *_ in rows} | {None: encode("text without an id")}
    got = packing.pack(docs, WORDS).collect()
    covered, n = check_packed(got, want)
    total = sum(len(want[i]) for i, *_ in rows + rows[:2]) + len(want[None])
    assert covered == total and n <= total / 4096 * 1.05 + 3


def test_packing_empty(empty):
    assert packing.pack(empty, WORDS).count() == 0


def test_combinations():
    assert set(packing.combinations(6)) == {(1, 5), (2, 4), (3, 3), (1, 1, 4), (1, 2, 3), (2, 2, 2)}


def test_least_squares():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, x = rng.random((12, 7)), np.maximum(rng.normal(size=7), 0)
        assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-5)
    a, b = np.array([[1.0, 1.0], [1.0, 1.0]]), np.array([-1.0, -1.0])
    assert (packing.nnls(a, b) == 0).all()


def test_plan_stays_within_the_histogram():
    rng = random.Random(4)
    for _ in range(10):
        histogram = {k: rng.randint(0, 500) for k in range(1, 64)}
        used: dict[int, int] = {}
        for combination, n in packing.plan(histogram, 64):
            assert sum(combination) == 64
            for x in combination:
                used[x] = used.get(x, 0) + n
        assert all(used.get(k, 0) <= v for k, v in histogram.items()) and sum(used.values()) > 0.5 * sum(histogram.values())
