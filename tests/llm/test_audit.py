"""Fingerprints, the filter audit and centroid clustering against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from wayrisk.llm import centroids, filter_audit, fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def phrases_of(text):
    """Level by level, (start, end) in the text of each phrase, by the parsing's own cuts."""
    spans = [(i, i + 1) for i in range(len(text))]
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = []
    while len(x):
        first = np.zeros(1, np.int64)
        new = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        spans = [(spans[a][0], spans[b - 1][1]) for a, b in zip(new, [*new[1:], len(x)], strict=True)]
        names, first = fingerprints.collapse(x, first)
        at = fingerprints.phrase_starts(names, first)
        spans = [(spans[a][0], spans[b - 1][1]) for a, b in zip(at, [*at[1:], len(names)], strict=True)]
        assert all(2 <= b - a <= 13 for a, b in zip(at, [*at[1:], len(names)], strict=True)) or len(names) == 1
        x = next(n for level, n, _ in fingerprints.levels([text]) if level == len(out) + 1)
        out.append((spans, x))
        if len(x) == 1:
            return out
    return out


def test_labels_by_definition():
    """Four rounds, name by name, and phrases at the local maxima."""
    rng = random.Random(3)
    x = [rng.randrange(1 << 64) for _ in range(300)]

    def tossed(names):
        out = []
        for i, v in enumerate(names):
            bit = 0 if not i else ((v ^ names[i - 1]) & -(v ^ names[i - 1])).bit_length() - 1
            out.append(2 * bit + (v >> bit & 1))
        return out

    labels = x
    for _ in range(4):
        labels = tossed(labels)
    assert max(labels) < 6
    want = [0] + [i for i in range(2, len(x) - 1) if labels[i - 1] < labels[i] > labels[i + 1]]
    assert fingerprints.phrase_starts(np.array(x, np.uint64), np.zeros(1, np.int64)).tolist() == want


def test_parsing_is_locally_consistent():
    rng = random.Random(7)
    text = lambda n: "".join(rng.choices("abcdefgh  éß漢", k=n))
    for _ in range(20):
        same, before, other, after = text(600), text(rng.randrange(90)), text(rng.randrange(90)), text(rng.randrange(90))
        a, b = phrases_of(before + same + after), phrases_of(other + same + text(50))
        for level, margin in ((0, 40), (1, 120), (2, 280)):
            inside = lambda spans, shift, m=margin: {(s - shift, e - shift) for s, e in spans if s - shift >= m and e - shift <= 600 - m}
            left, right = inside(a[level][0], len(before)), inside(b[level][0], len(other))
            assert left == right and (left or level == 2)
        # a name stands for one string, and a string inside both has one name
        meaning = {}
        for parsed, whole in ((a, before + same + after),):
            for level, (spans, names) in enumerate(parsed):
                for (s, e), name in zip(spans, names.tolist(), strict=True):
                    assert meaning.setdefault((level, name), whole[s:e]) == whole[s:e]


def test_fingerprints_alone_and_together(rows):
    texts = [t or "" for _, t, *_ in rows] + ["aaaa" * 1000, "ab" * 5000, "a", "\U0010ffff\x00"]
    together = fingerprints.fingerprints(texts)
    assert together == [fingerprints.fingerprints([t])[0] for t in texts]
    root = lambda f: f[:16]
    assert len(set(map(root, together))) == len(set(texts)) == len(set(together))
    assert fingerprints.likeness(together[0], together[0]) == 1 and fingerprints.likeness(together[texts.index("")], together[0]) == 0


def test_likeness_follows_overlap():
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))
    for share in (0.9, 0.75, 0.5, 0.0):
        got = []
        for _ in range(30):
            a = text(400)
            cut = int(len(a) * share)
            x, y = fingerprints.fingerprints([a, a[:cut] + text(400)[: len(a) - cut]])
            got.append(fingerprints.likeness(x, y))
        assert abs(np.mean(got) - share / (2 - share)) < 0.06


def neighbours(pairs):
    """Edited texts by definition; ``pairs`` has (id, text), ids unique but for repeated rows."""
    low = -(2**63)
    place = lambda i: low if i is None else i
    ids = sorted({place(i) for i, _ in pairs})
    following = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    of = {place(i): t or "" for i, t in pairs}
    return {(i, t): of[following[place(i)]] for i, t in pairs}


@pytest.mark.parametrize("partitions", [1, 7])
def test_edits(spark, docs, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pairs = [(i, t) for i, t, *_ in rows + rows[:2]] + [(None, "text without an id")]
        got = fingerprints.fingerprint_edits(docs).collect()
        many = spark.createDataFrame([(5, "five")] * 300 + [(9, "nine nine nine")] + [(2, "second text")], "doc_id long, text string").repartition(5)
        hot = fingerprints.fingerprint_edits(many).collect()
        one = fingerprints.fingerprint_edits(spark.createDataFrame([(5, "abcdefgh")] * 40, "doc_id long, text string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    following = neighbours(pairs)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in pairs)
    by = {r.doc_id: r for r in got}
    for (i, t), after in following.items():
        t, r = t or "", by[i]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert [r.fingerprint, r.edited_fingerprint] == fingerprints.fingerprints([t, edited])
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fingerprints.likeness(r.fingerprint, fingerprints.fingerprints([after])[0])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in hot) == {(5, sha("fivn")): 300, (9, sha("nine nine n" + "sec")): 1, (2, sha("second te" + "fi")): 1}
    assert {(r.edited_sha256, r.near_edited, r.near_next) for r in one} == {(sha("abcdefab"), one[0].near_edited, 1.0)} and len(one) == 40


def test_sources_of_open_rows():
    """(partition, largest, smallest, several): the neighbour is the smallest larger place, wherever it stands."""
    assert fingerprints._sources([]) == []
    assert fingerprints._sources([(0, 9, 9, False)]) == [(0, 0, 2)]
    ends = [(0, 9, 7, True), (2, 7, 7, False), (3, 7, 7, False), (5, 6, 5, True)]
    assert fingerprints._sources(ends) == [(0, 5, 2), (2, 0, 3), (3, 0, 3), (5, 3, 2)]


def test_edits_of_several_texts_and_none(spark, empty):
    assert fingerprints.fingerprint_edits(empty).count() == 0
    df = spark.createDataFrame([(1, "abcdefgh"), (2, "x1"), (2, "x2"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_chars): r.edited_sha256 for r in fingerprints.fingerprint_edits(df).collect()}
    assert got[1, 8] in {hashlib.sha256(b"abcdef" + t).hexdigest() for t in (b"x1", b"x2")} and got[3, 0] == hashlib.sha256(b"").hexdigest()
    assert fingerprints.fingerprint_edits(df.repartition(4)).where("doc_id = 1").first().edited_sha256 == got[1, 8]


def audited(rows, labels):
    """Order by order and step by step, over sets of documents."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails, part = collections.defaultdict(set), collections.defaultdict(set)
    for k, (i, t, lang) in enumerate(rows):
        t = t or ""
        words = WORD.findall(t)
        judged = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]]
        for f, x in zip("ABCDE", judged, strict=True):
            if x:
                fails[f].add(k)
        part[lang or ""].add(k)
    out, shapley = {}, collections.Counter()
    for p, own in part.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = set(own)
            for step, f in enumerate(order, 1):
                lost = left & fails[f]
                before = left
                left = left - fails[f]
                alone = {k for k in own & fails[f] if sum(k in fails[x] for x in "ABCDE") == 1}
                hit = lambda ids, lost=lost: sum(rows[k][0] is not None and rows[k][0] in ids for k in lost)
                out[p, order, step] = [len(left), len(lost), len((own & fails[f]) - before), len(alone), hit(good), hit(toxic)]
                shapley[p, f] += len(lost)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


@pytest.mark.parametrize("support", [0.001, 0.2])
def test_audit(spark, empty, support):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["CAPITALS", "a#b", "x y", "é"]
    rows = []
    for i in range(160):
        t = " ".join(rng.choices(words[: rng.choice([20, 304])], k=rng.choice([3, 150, 260, 500])))
        rows.append((i, t if rng.random() < 0.8 else t.upper(), rng.choice(["en", "fr", None, ""])))
    rows += [(1000 + i, rows[i % 7][1], "de") for i in range(60)] + [(None, rows[0][1], "en"), (None, None, "en"), (-3, None, "xx"), (2000, "", "xx"), rows[3], rows[3]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1100, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, bits int, digest string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks, support=support).collect()
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in got} == audited(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows}) and filter_audit.audit(empty, marks).count() == 0


def test_index_counts_by_row():
    rng = np.random.default_rng(2)
    bits, parts = rng.integers(0, 128, 1000).astype(np.uint8), rng.integers(0, 3, 1000)
    got = filter_audit.index_counts(parts, 3, bits)
    for k, (s, f) in enumerate(filter_audit._STEPS):
        for p in range(3):
            mine = [int(b) for b, q in zip(bits, parts, strict=True) if q == p]
            lost = [b for b in mine if not b & s and b >> f & 1]
            assert got[p, k].tolist() == [sum(not b & s and not b >> f & 1 for b in mine), len(lost), sum(b & s > 0 and b >> f & 1 for b in mine), sum(b >> 5 & 1 for b in lost), sum(b >> 6 & 1 for b in lost)]


def clustered(vectors, k, rounds, seed=1):
    """All distances in every round, in whole numbers; ``vectors`` has (id, whole numbers)."""
    order = sorted(vectors, key=lambda v: (hashlib.sha256(f"{seed}:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1]))
    c = [list(v) for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in vectors:
            own[nearest(v)[1]].append(v)
        for j, vs in own.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *nearest(v)) for i, v in vectors]
    inertia = collections.Counter()
    for _, d, j in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in found)


@pytest.mark.parametrize(("n", "k", "size", "spread"), [(400, 16, 4, 2), (300, 16, 3, 40), (500, 24, 2, 6), (9, 16, 5, 3), (200, 1, 2, 9), (60, 2, 2, 3)])
def test_centroids(spark, n, k, size, spread):
    rng = random.Random(n + k)
    whole = [(i, [rng.randint(-spread, spread) for _ in range(size)]) for i in range(n)] + [(3, [0] * size), (3, [0] * size), (None, [1] * size)]
    rows = [(i, [x / 8 + rng.choice([0, 0.06]) for x in v], 1, "x") for i, v in whole]
    bad = [(90, [1.0] * (size + 1)), (91, None), (92, [float("nan")] * size), (93, [float("inf")] + [0.0] * (size - 1)), (94, [None] + [1.0] * (size - 1)), (95, [])]
    df = spark.createDataFrame(rows + [(i, v, 1, "x") for i, v in bad], "vec_id long, embedding array<double>, cluster int, x string").repartition(3)
    got = centroids.cluster(df, k=k, rounds=4, size=size, scale=8)
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()) == clustered(whole, k, 4)


def test_centroids_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema), 4, 2, 2, 64).count() == 0
    far = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.0])], schema)
    got = centroids.cluster(far, 2, 2, 2, 64)
    assert got.count() == 3 and all(0 <= r.distance < 1 << 62 for r in got.collect())


def test_bounds_spare_distances():
    """After the first scan most vectors are settled by their bounds, and no answer differs from a full scan."""
    rng = np.random.default_rng(8)
    truth = rng.integers(-400, 400, (16, 8))
    x = truth[rng.integers(0, 16, 4000)] + rng.integers(-25, 26, (4000, 8))
    c = x[:16].copy()
    near, d, bounds, rest = centroids.scan(x, c, 4)
    spared = []
    for _ in range(6):
        new = np.array([x[near[:, 0] == j].sum(axis=0) // max(1, (near[:, 0] == j).sum()) if (near[:, 0] == j).any() else c[j] for j in range(16)])
        moved, c = centroids._above(((new - c) ** 2).sum(axis=1)), new
        near, d, bounds, rest, depth = centroids.reassign(x, c, moved, near, bounds, rest, 4)
        full = centroids.distances(x, c)
        assert (near[:, 0] == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
        exact = np.sqrt(np.take_along_axis(full, near.astype(np.int64), axis=1))
        assert (bounds <= exact).all()
        others = np.array([np.delete(row, ids).min() for row, ids in zip(full, near, strict=True)])
        assert (rest <= np.sqrt(others)).all()
        spared.append((depth == 0).mean())
    assert spared[-1] > 0.9
