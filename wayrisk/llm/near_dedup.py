"""MinHash near-dedup by a multi-index Hamming join.

A document's set holds its distinct shingles of five words (words are runs of anything but ASCII white
space, A-Z lower-cased); shingles are kept as 64-bit hashes. Its signature has 48 symbols of b = 16 bits,
each from the minimum of the set under another hash, so that two documents differ in a symbol with
probability 1 - similarity. Pairs of signatures with at most 22 differing symbols are candidates; at a
similarity of 0.75 that is exceeded with probability 4.98e-4.

The signature is split into 12 chunks of 4 symbols. By pigeonhole, two signatures with at most 22 errors
have at most ``22 // 12`` = 1 error in some chunk. The allowed errors of a chunk are enumerated: each of its 4
symbols is left out once, and the other 3 are a key. So every pair under the threshold shares one of 48 keys.

No bucket's pairs are all compared:

1. Documents with the same words form one class, named by a number of its own, of which only one member goes on.
2. Each member of a bucket is compared with the bucket's representative only, the member that shares most keys
   with others; verified links give components.
3. Buckets that still hold several components are open. Up to ``SMALL`` members are held against each other, once for each pair. The members of larger
   ones are split by rare shingles. With all shingles in one order, rarest first,
   two sets m <= n of similarity p share a shingle among the first m - 2pm/(1 + p) + 1 of the one and n - pn + 1 of the other. So an
   open class is a row for each shingle of its beginning that others have, and only classes that meet in one are compared. Texts of one family that
   are no links have more shingles of their own than such a beginning holds, and don't meet; whatever the order, no link is lost.
   Rarity comes from a table of ``PLACES`` counters over these classes' shingles, whose size doesn't grow.

   A pair comes out of either if its classes are of different components and alike by size, signature and a bitmap of their shingles: two sets differ in
   at least as many shingles as their bitmaps in bits.

Every link is confirmed on the full sets. Those are made once for each class that shares a key; pairs are
joined to them on either side, which adaptive execution splits where a representative has many pairs.
Components come from label propagation with pointer jumping over DataFrames; no links or labels are collected.

Defined results: null and empty texts and texts without words have an empty set and no links; shorter
texts have their whole sequence of words as their only shingle; rows with a null id have no links and
aren't kept (``keep_one`` names rows by id and text, null ids last, so that they have links there); rows that repeat id and text get the same result;
an id on several texts has all links of each, and a row's component is that of its own text; an empty table gives an empty
result; other columns, whatever their names, pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.llm._shared import WordHash, checkpoint, fresh, remember, window_hashes, word_array

WORDS = 5
PERCENT = 75
SYMBOLS, CHUNK = 48, 4
#: Symbols in which two signatures may differ, and errors that some chunk then has at most.
APART = 22
ERRORS = APART // (SYMBOLS // CHUNK)
#: 64-bit words of a class's bitmap.
MAP_WORDS = 16
_MEMO = WordHash()
#: Members of an open bucket that are simply held against each other.
SMALL = 64
#: Counters of how often shingles occur.
PLACES = 1 << 20
#: Shingles that are hashed at once.
_PART = 32_768
_rng = np.random.default_rng(20240131)
_A = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return (text or "").encode().lower().split()


def _set_of(words: list[bytes]) -> np.ndarray:
    return np.unique(window_hashes(word_array(words, _MEMO), min(WORDS, len(words)))) if words else np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the set of ``text``."""
    return _set_of(words_of(text))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of symbols for each of ``sets``, none of them empty."""
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    first = 0
    while first < len(sets):
        end, size = first + 1, len(sets[first])
        while end < len(sets) and size + len(sets[end]) <= _PART:
            size += len(sets[end])
            end += 1
        h = np.concatenate(sets[first:end])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[first : end - 1]], dtype=np.int64)))
        for k in range(SYMBOLS):
            out[first:end, k] = np.minimum.reduceat(h * _A[k] + _B[k], starts) >> np.uint64(24) & np.uint64(0xFFFF)
        first = end
    return out


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit for each place modulo its size that some hash falls on."""
    bits = np.zeros(64 * MAP_WORDS, np.uint8)
    bits[hashes % np.uint64(64 * MAP_WORDS)] = 1
    return np.packbits(bits).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remember("near", _MEMO)
    for b in batches:
        n, digest, sets = [], [], []
        for t in b.column(1).to_pylist():
            w = words_of(t)
            sets.append(_set_of(w))
            n.append(len(sets[-1]))
            digest.append(xxhash.xxh3_128_digest(b" ".join(w)) if w else None)
        some = [s for s in sets if len(s)]
        # list arrays straight from the numbers; a set without shingles has null
        starts = np.concatenate(([0], np.cumsum([len(s) > 0 for s in sets]))).astype(np.int32)
        lists = lambda values, width: pa.ListArray.from_arrays(pa.array(starts * width), pa.array(values.ravel()), mask=pa.array(np.diff(starts) == 0))
        bits = np.concatenate([bitmap(s) for s in some]) if some else np.zeros(0, np.int64)
        arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists(signatures(some).view(np.int16), SYMBOLS), lists(bits, MAP_WORDS)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "digest", "sig", "bits"])


def _keys(sig: Column) -> Column:
    """The keys of a signature: of each chunk, what is left when one symbol after the other is an error."""
    chunks = [range(c, c + CHUNK) for c in range(0, SYMBOLS, CHUNK)]
    return F.array(*(F.xxhash64(F.lit(k), *(sig[i] for i in c if i != k)) for c in chunks for k in c))


def _agreed_key(a: Column, b: Column) -> Column:
    """The first place among the keys of two signatures that they share."""
    chunk = lambda j: F.sequence(j - j % CHUNK, j - j % CHUNK + (CHUNK - 1))
    same = lambda j: F.forall(chunk(j), lambda i: (i == j) | (F.get(a, i) == F.get(b, i)))
    return F.array_min(F.filter(F.sequence(F.lit(0), F.lit(SYMBOLS - 1)), same))


def _alike(a: str, b: str) -> Column:
    """Sets that may be similar, by size and bitmap, and signatures within ``APART``.

    Two sets are similar if they differ in at most (100 - P) / (100 + P) of their sizes' sum, and differ at least as their bitmaps do.
    """
    differ = lambda words: sum((F.bit_count(F.col(a + "bits")[i].bitwiseXOR(F.col(b + "bits")[i])) for i in words), F.lit(0))
    most = (F.col(a + "n") + F.col(b + "n")) * (100 - PERCENT)
    sizes = F.least(a + "n", b + "n") * 100 >= F.greatest(a + "n", b + "n") * PERCENT
    half = differ(range(0, MAP_WORDS, 2)) * (100 + PERCENT) <= most
    whole = differ(range(MAP_WORDS)) * (100 + PERCENT) <= most
    errors = F.size(F.filter(F.zip_with(a + "sig", b + "sig", lambda x, y: x != y), lambda e: e))
    return sizes & half & whole & (errors <= APART)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, set of a, set of b), the pairs that are similar."""
    for batch in batches:
        keep = []
        for s, t in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among ``pairs`` (a, b), each confirmed on the full sets."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(_linked, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``links`` (a, b) reaches.

    Each round takes the smallest label among a node and its neighbours, then that label's own label.
    """
    edges = checkpoint(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = checkpoint(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        new = label.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = checkpoint(new.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("label")))
        label = new.select("node", "label")
        if not new.where("old <> label").limit(1).count():
            return label


def _shared_keys(classes: DataFrame) -> DataFrame:
    """(key, at, id): the keys that several classes have; ``at`` is the key's place."""
    each = classes.select("id", F.posexplode(_keys(F.col("sig"))).alias("at", "key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    return checkpoint(each.join(often.select("key"), "key").select("key", "at", "id"))


def _stars(keyed: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a bucket's representative and each other member."""
    typical = keyed.groupBy("id").agg(F.count(F.lit(1)).alias("keys"))
    heads = keyed.join(typical, "id").groupBy("key").agg(F.min(F.struct(-F.col("keys"), "id")).alias("head"))
    star = keyed.join(heads, "key").select(F.col("head.id").alias("h"), "id").where("h <> id")
    return star.select(F.least("h", "id").alias("a"), F.greatest("h", "id").alias("b")).distinct()


def _open(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, at, id, label, large): members of buckets with several components; ``labels`` has id and label, where it isn't the id."""
    members = keyed.join(labels, "id", "left").select("key", "at", "id", F.coalesce("label", "id").alias("label"))
    buckets = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), (F.count(F.lit(1)) > SMALL).alias("large"))
    return checkpoint(members.join(buckets.where("lo <> hi").select("key", "large"), "key"))


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(PLACES)).astype(np.int64)


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many shingles of ``sets`` fall on each place: ``PLACES`` counters."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PLACES, np.int64)
        for b in batches:
            for s in b.column(0):
                np.add.at(counts, _place(np.frombuffer(s.as_buffer(), np.uint64)), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["place", "n"])

    counted_rows = sets.select("set").mapInArrow(counted, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    rarity = np.zeros(PLACES, np.int64)
    rarity[counted_rows["place"].to_numpy()] = counted_rows["n"].to_numpy()
    return np.minimum(rarity, np.iinfo(np.uint32).max).astype(np.uint32)


def _beginnings(sets: DataFrame) -> DataFrame:
    """(token, band, place, id, small): the rare beginnings of ``sets`` (id, set), but for shingles that one class has alone.

    ``band`` is the size's power of a little more than 100 / P; a larger partner is in the same band or the next.
    """
    rarity = _rarity(sets)
    wide = float(np.log(100 / PERCENT + 0.01))

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tokens, places, rows, sizes, small = [], [], [], [], []
            for i, s in enumerate(b.column(1)):
                h = np.frombuffer(s.as_buffer(), np.uint64)
                n = len(h)
                often = rarity[_place(h)]
                first = np.lexsort((h, often))[: n - -(-PERCENT * n // 100) + 1]
                shared = np.flatnonzero(often[first] > 1)
                tokens.append(h[first][shared].view(np.int64))
                places.append(shared)
                small.append(shared <= n - -(-2 * PERCENT * n // (100 + PERCENT)))
                rows.append(np.full(len(shared), i))
                sizes.append(np.full(len(shared), n, np.int64))
            bands = (np.log(np.concatenate(sizes)) / wide).astype(np.int32)
            ids = b.column(0).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(bands), pa.array(np.concatenate(places)), ids, pa.array(np.concatenate(small))], names=["token", "band", "place", "id", "small"])

    return sets.select("id", "set").mapInArrow(begun, "token bigint, band int, place bigint, id bigint, small boolean")


def _sides(rows: DataFrame, key: list[str], named: DataFrame) -> list[DataFrame]:
    """``rows`` twice, with what ``_alike`` and ``_between`` compare, as columns that begin with a and b."""
    full = rows.join(named, "id")
    return [full.select(*key, *(F.col(f"`{c}`").alias(p + c) for c in full.columns if c not in key)) for p in "ab"]


def _met(rows: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Beginnings as (smaller, larger) sides that meet on token and band; only tokens of several components."""
    several = rows.join(named.select("id", "label"), "id").groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    rows = checkpoint(rows.join(several, "token", "left_semi"))
    a, b = _sides(rows, ["token", "band"], named)
    return a.where("asmall"), b.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))


def _between(keyed: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that are alike, of different components in a bucket; ``classes`` has id, n, sig, bits."""
    members = _open(keyed, labels)
    named = classes.select("id", "n", "sig", "bits").join(members.select("id", "label").distinct(), "id")
    few, many = members.where("not large").drop("label", "large"), members.where("large").select("id").distinct()

    a, b = _sides(few, ["key"], named)
    once = _agreed_key(F.col("asig"), F.col("bsig")) == F.col("aat")
    pairs = a.join(b, "key").where(F.expr("aid < bid and alabel <> blabel") & _alike("a", "b")).where(once).select("aid", "bid")

    # from a place on, and that is where two sets first meet, they can share no more than what is left of either
    smaller, larger = _met(_beginnings(sets.join(many, "id")), named)
    fits = f"alabel <> blabel and (an < bn or an = bn and aid < bid) and least(an - aplace, bn - bplace) * (100 + {PERCENT}) >= (an + bn) * {PERCENT}"
    met = smaller.join(larger, ["token", "band"]).where(F.expr(fits) & _alike("a", "b")).select("aid", "bid")
    return checkpoint(pairs.unionByName(met).select(F.col("aid").alias("a"), F.col("bid").alias("b")).distinct())


def _alike_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    of = lambda p: classes.select(F.col("id").alias(p), *(F.col(c).alias(p + c) for c in ("n", "sig", "bits")))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(_alike("a", "b")).select("a", "b")


def group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    signed = checkpoint(source.mapInArrow(_signed, f"doc_id {kind}, n bigint, digest binary, sig array<smallint>, bits array<bigint>"))

    members = signed.where("digest is not null and doc_id is not null")
    firsts = members.groupBy("digest").agg(F.min("doc_id").alias("first"))
    one = members.withColumnRenamed("doc_id", "first").join(firsts, ["digest", "first"], "left_semi").dropDuplicates(["digest"])
    classes = checkpoint(one.withColumn("id", F.monotonically_increasing_id()))  # numbers are fixed by the checkpoint
    keyed = _shared_keys(classes)
    classes = checkpoint(classes.join(keyed.select("id").distinct(), "id", "left_semi"))

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember("near", _MEMO)
        for b in batches:
            words = [words_of(t) for t in b.column(0).to_pylist()]
            arrays = [pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()), pa.array([_set_of(w).tobytes() for w in words], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["digest", "set"])

    # the texts of the ids that stand for classes; of several texts of an id, the digests choose
    of_id = source.join(classes.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").select("text")
    sets = of_id.mapInArrow(full_sets, "digest binary, set binary").join(classes.select("digest", "id"), "digest")
    sets = checkpoint(sets.dropDuplicates(["id"]).select("id", "set"))

    # Every member of a bucket against its representative.
    links = checkpoint(_verified(_alike_pairs(_stars(keyed), classes), sets))
    labels = components(links)

    # Buckets that still hold several components.
    between = _between(keyed, labels.withColumnRenamed("node", "id"), classes, sets)
    if not between.isEmpty():
        more = checkpoint(_verified(between, sets))
        if not more.isEmpty():
            labels = components(links.union(more))

    linked = labels.join(classes.select(F.col("id").alias("node"), "digest", "first"), "node")
    smallest = linked.groupBy("label").agg(F.min("first").alias("component"))
    by_digest = firsts.join(linked.join(smallest, "label").select("digest", "component"), "digest", "left").select("digest", F.coalesce("component", "first").alias("component"))
    out = signed.drop("sig", "bits").join(by_digest, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``group`` keeps, with all their columns.

    Rows are named by id and text here, null ids after all others, so that each text has links of its own and one of a group stays.
    """
    own, mine = F.col(f"`{doc_id}`"), fresh(docs, "kept")
    sha = F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256))
    name = F.struct(own.isNull().alias("none"), own.alias("id"), sha.alias("sha"))
    kept = group(docs.select(name.alias("name"), F.col(f"`{text}`").alias("text")), "text", "name").where("kept").select(F.col("doc_id").alias(mine)).distinct()
    return docs.join(kept, name == F.col(mine), "left_semi")
