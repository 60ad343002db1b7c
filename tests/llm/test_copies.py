"""Exact dedup, near-dedup and repeated passages against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import components_of
from wayrisk.llm import exact_dedup, near_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("support", [0.001, 0.02])
def test_exact(docs, rows, support):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows + rows[:2]:
        groups[t or ""].append(i)
    got = exact_dedup.mark_copies(docs, support=support).where("doc_id is not null").collect()
    assert len(got) == len(rows) + 2
    by_id = {i: t or "" for i, t, *_ in rows}
    for r in got:
        g = groups[by_id[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.doc_id == max(g))
        assert r.text_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest()
    kept = exact_dedup.drop_copies(docs, support=support)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.where("doc_id is not null").collect()} == {max(g) for g in groups.values()}


@pytest.mark.parametrize("support", [0.001, 0.3])
def test_one_row_for_each_text(spark, support):
    """Null ids survive once, repeated rows collapse, in the exact and the near stage."""
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(None, "a", 1), (None, "a", 1), (None, "b", 1), (3, "c", 1), (3, "c", 1), (3, "c", 2), (None, "c", 9), (None, None, 1), (None, "", 1), (5, long, 1), (None, long + " x", 1), (None, f"y {long} x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    kept = exact_dedup.drop_copies(df, support=support)
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(None, "a"), (None, "b"), (3, "c"), (None, ""), (5, long), (None, long + " x"), (None, f"y {long} x")], key=str)
    near = [(r.doc_id, r.text or "") for r in near_dedup.keep_one(kept).collect()]
    assert sorted(near, key=str) == sorted([(None, "a"), (None, "b"), (3, "c"), (None, ""), (5, long)], key=str)


def test_near(docs, rows):
    want = components_of(rows)
    got = near_dedup.group(docs).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_near_recall_as_stated():
    n, most = near_dedup.SYMBOLS, near_dedup.APART
    missed = sum(math.comb(n, k) * 0.25**k * 0.75 ** (n - k) for k in range(most + 1, n + 1))
    assert f"probability {missed * 1e4:.2f}e-4" in near_dedup.__doc__


def test_near_keys(spark):
    """Signatures with the allowed errors share a key however the errors lie, and the first one is found from the signatures."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        a = [rng.randrange(2**31) for _ in range(near_dedup.SYMBOLS)]
        b = a[:]
        for k in rng.sample(range(near_dedup.SYMBOLS), near_dedup.APART if i % 2 else 40):
            b[k] += 1
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>")
    keys = lambda c: near_dedup._keys(F.col(c)).alias("k" + c)
    for r in df.select("i", keys("a"), keys("b"), near_dedup._agreed_key(F.col("a"), F.col("b")).alias("first")).collect():
        same = [k for k, (x, y) in enumerate(zip(r.ka, r.kb, strict=True)) if x == y]
        assert (same or r.i % 2 == 0) and r.first == (same[0] if same else None)


def test_near_bitmaps():
    """Bitmaps differ in no more bits than sets in shingles, and signatures of many sets are those of each."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 5, 300, 40_000, 70_000, 9)]
    for a in sets:
        for b in sets:
            bits = int(np.bitwise_count((near_dedup.bitmap(a) ^ near_dedup.bitmap(b)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(a, b))
    together = near_dedup.signatures(sets)
    assert all((near_dedup.signatures([s])[0] == together[i]).all() for i, s in enumerate(sets))


def test_near_family(spark):
    """Hundreds of texts about one passage, of which few are linked: the links are those of brute force, and few pairs come out."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = base[:]
        for k in rng.sample(range(120), rng.choice([0, 1, 4, 5, 6, 8, 10])):
            words[k] = f"n{i}x{k}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = components_of(rows)
    assert 50 < len({c for _, c in want.values()}) < 350
    made, between = [], near_dedup._between
    near_dedup._between = lambda *a: made.append(between(*a)) or made[-1]
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.group(df).collect()}
    finally:
        near_dedup._between = between
    assert got == want and made[0].count() < 4_000


def compared(spark, df, monkeypatch):
    """(rows of ``group``, pairs that open classes were held against each other, pairs with a representative)."""
    made, met, stars = [], near_dedup._met, near_dedup._stars
    monkeypatch.setattr(near_dedup, "_met", lambda *a: made.append(met(*a)) or made[-1])
    with_head = []
    monkeypatch.setattr(near_dedup, "_stars", lambda *a: with_head.append(stars(*a)) or with_head[-1])
    got = near_dedup.group(df).collect()
    return got, sum(a.join(b, ["token", "band"]).count() for a, b in made), with_head[0].count()


@pytest.mark.parametrize("own", [45, 30])
def test_near_unlinked_family(spark, monkeypatch, own):
    """Thousands of texts that share most of their shingles and no link: few are compared at all."""
    n = 5_000 if own == 45 else 800
    rows = [(i, " ".join([*(f"p{k}" for k in range(120)), *(f"o{i}x{k}" for k in range(own))])) for i in range(n)]
    got, pairs, with_head = compared(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), monkeypatch)
    assert len(got) == n and all(r.kept and r.n_shingles == 116 + own for r in got)
    assert pairs + with_head < 50 * n


@pytest.mark.parametrize("small", [2, 64])
def test_near_open_buckets(spark, monkeypatch, small):
    """Texts about shared passages in all proportions and sizes, linked and not; no link is lost and comparisons stay few."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(300):
        size = rng.choice([60, 90, 120, 200])
        start = rng.choice([0, 0, 0, 40, 100])
        own = [f"n{rng.choice([i, i - i % 3])}x{k}" for k in range(rng.choice([0, 2, 10, 15, 25, 40]))]
        rows.append((i, " ".join(base[start : start + size] + own)))
    got, _, _ = compared(spark, spark.createDataFrame(rows, "doc_id long, text string"), monkeypatch)
    want = components_of(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and 20 < len({c for _, c in want.values()}) < 280


def test_near_ids_on_several_texts(spark):
    """An id on two texts keeps the links of both, and one row of each group stays."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (3, b + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.group(df).collect()}
    assert got == {(1, 56, 1, True), (2, 57, 1, False), (2, 56, 2, True), (3, 57, 2, False)}
    assert sorted(map(tuple, near_dedup.keep_one(df).collect())) == [(1, a), (2, b)]


def test_near_chains(spark):
    """Chains of links, in which the first and the last text aren't linked, in one component."""
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*(f"n{k}x{i}" for i in range(18 * (k % 8))), *base[18 * (k % 8) :]])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = components_of(rows)
    assert {(r.doc_id, r.component_id) for r in near_dedup.group(df).collect()} == {(k, v[1]) for k, v in want.items()}


def test_keep_one_and_empty(docs, empty):
    got = near_dedup.keep_one(docs)
    assert got.columns == docs.columns and got.where("text = 'One'").count() == 0
    for names in (["__keep", "__size", "__digest", "__kept"], ["keep", "size", "digest_", "rank", "kept_", "a.b"]):
        odd = docs.selectExpr("*", *(f"{k} as `{x}`" for k, x in enumerate(names)))
        for f in (exact_dedup.drop_copies, near_dedup.keep_one):
            mine = f(odd)
            assert mine.columns == odd.columns
            rows = mine.select("doc_id", "text", *(f"`{x}`" for x in names)).collect()
            assert sorted((r[:2] for r in rows), key=str) == sorted(map(tuple, f(docs).select("doc_id", "text").collect()), key=str)
            assert {tuple(r[2:]) for r in rows} == {tuple(range(len(names)))}
    assert near_dedup.group(empty).count() == 0 and exact_dedup.mark_copies(empty).count() == 0 and substring_dedup.remove_repeats(empty).count() == 0


def test_repeats(docs, rows):
    all_rows = [(i, t) for i, t, *_ in rows + rows[:2]] + [(None, "text without an id")]
    count = collections.Counter(tuple(w[k : k + 35]) for _, t in all_rows for w in [WORD.findall(t or "")] for k in range(len(w) - 34))
    want = collections.Counter()
    for i, t in all_rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        left = " ".join(x for x, k in zip(w, keep) if k)
        want[i, len(w), len(w) - sum(keep), hashlib.sha256(left.encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, substring_dedup.remove_repeats(docs).collect())) == want


def test_batches_spread():
    """The first batches of many tasks go to many groups."""
    groups = set()
    for partition in range(300):
        batch = substring_dedup._Batch(100, True)
        batch.add(1, np.arange(3, dtype=np.uint64), None, np.arange(3, dtype=np.uint64))
        groups |= {g for g, _, kind, _ in batch.flush(partition << 24) if kind == 1}
    assert len(groups) > 80 and min(groups) >= 100


def test_repeats_over_batches(spark, docs, rows, monkeypatch):
    """One partition a document, so that repeats meet only across batches."""
    whole = {tuple(r) for r in substring_dedup.remove_repeats(docs).collect()}
    assert {tuple(r) for r in substring_dedup.remove_repeats(docs.repartition(40, F.rand(3))).collect()} == whole
