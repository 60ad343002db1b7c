"""Centroid clustering with Drake's adaptive bounds, exact to the last tie.

Vectors of whole numbers go to the nearest of k centroids (squared Euclidean distance, ties to the smaller number), and
centroids become their vectors' componentwise floor of the mean, for a fixed number of rounds.

Each vector keeps a list of its b nearest centroids, a lower bound of the distance to each, and one remainder bound for all other
centroids. After a round, a bound falls by as much as its centroid moved, the remainder by the farthest move. Then:

1. The distance to the vector's centroid so far is computed. If it is below all bounds, the assignment stands.
2. Otherwise, if it is below the remainder, the listed centroids whose bounds it reaches are computed, which settles the vector.
3. Where even that is not certified, all k distances are computed exactly and the list is made anew.

Distances are exact whole numbers; bounds are rounded down and moves up, and only a strictly smaller distance certifies, so that
ties are always decided by exact distances. b adapts: it starts at k / 4 and falls, but not under k / 8, to the deepest place of the list that any vector
needed; bounds that fall off the list go into the remainder.

A round is one pass over a table of vectors with their bounds, written to the shared folder, and one aggregate of k sums. Only centroids,
their counts and their inertia (k rows) reach the driver and go out again; nothing is shuffled but the partial sums.

Defined results: vectors with another number of components, or with a null, NaN or infinite one, are left out. Components are scaled, floored, and
held within 2**26 either way, so that squared distances fit a long (with the scale of 64, components under a million are
unchanged); inertia that doesn't fit a long is null. A null id seeds as the empty text and stays null. Rows that repeat an id are vectors of their own; of equal seeds the
componentwise smaller goes first. With fewer vectors than centroids, there are as many centroids as vectors; an empty table
gives an empty result. Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.llm._shared import delete_table, shared_folder

#: Components are held within this.
MOST = 1 << 26
#: Under this, products and sums of 64-bit floats are exact for up to 4,096 components.
_FLOAT = 1 << 20
_BATCH = 8_192


def whole(vector: Column, size: int, scale: int) -> Column:
    """The vector's whole numbers, or null if it isn't one of ``size`` finite components."""
    fits = (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < math.inf))
    number = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int")
    return F.when(F.coalesce(fits, F.lit(False)), F.transform(vector, number))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances [vector, centroid] of whole numbers."""
    small = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _FLOAT and x.shape[1] <= 4096
    a, b = (x.astype(np.float64), c.astype(np.float64)) if small else (x, c)
    cross = (a @ b.T).astype(np.int64)
    return (x * x).sum(axis=1)[:, None] - 2 * cross + (c * c).sum(axis=1)[None, :]


def _below(squared: np.ndarray) -> np.ndarray:
    """Square roots, rounded down for certain."""
    return np.nextafter(np.nextafter(np.sqrt(squared.astype(np.float64)), -math.inf), -math.inf)


def _above(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(np.sqrt(squared.astype(np.float64)), math.inf), math.inf)


def scan(x: np.ndarray, c: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(own, distance), nearest first with ``b`` listed others: ids [n, b + 1], squared distance, bounds [n, b + 1], remainder."""
    d = distances(x, c)
    order = np.argsort(d, axis=1, kind="stable")  # ties by the smaller number
    ranked = np.take_along_axis(d, order, axis=1)
    b = min(b, len(c) - 1)
    rest = _below(ranked[:, b + 1]) if b + 1 < len(c) else np.full(len(x), math.inf)
    return order[:, : b + 1].astype(np.int32), ranked[:, 0], _below(ranked[:, : b + 1]), rest


def reassign(x: np.ndarray, c: np.ndarray, moved: np.ndarray, ids: np.ndarray, bounds: np.ndarray, rest: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The state after centroids moved by at most ``moved`` to ``c``: ids, squared distance, bounds, remainder, and the place of the list that was needed.

    The first listed id is the vector's centroid.
    """
    n = len(x)
    if ids.shape[1] > b + 1:  # bounds that fall off the list go into the remainder
        rest = np.minimum(rest, bounds[:, b + 1 :].min(axis=1))
        ids, bounds = ids[:, : b + 1], bounds[:, : b + 1]
    ids = ids.copy()
    bounds = np.nextafter(bounds - moved[ids], -math.inf)
    rest = np.nextafter(rest - moved.max(initial=0), -math.inf)
    diff = x - c[ids[:, 0]]
    best = (diff * diff).sum(axis=1)
    own = best.copy()
    u = _above(best)
    bounds[:, 0] = _below(own)
    certified = rest > u
    depth = np.zeros(n, np.int32)
    place = np.zeros(n, np.int64)
    for j in range(1, ids.shape[1]):
        at = np.flatnonzero(certified & (bounds[:, j] <= u))
        if len(at):
            diff = x[at] - c[ids[at, j]]
            d = (diff * diff).sum(axis=1)
            bounds[at, j] = _below(d)
            depth[at] = j
            nearer = (d < best[at]) | (d == best[at]) & (ids[at, j] < ids[at, place[at]])
            won = at[nearer]
            best[won], place[won] = d[nearer], j
    # the new centroid changes places with the old one
    rows = np.arange(n)
    for a in (ids, bounds):
        first = a[:, 0].copy()
        a[:, 0] = a[rows, place]
        a[rows, place] = np.where(place > 0, first, a[rows, place])
    left = np.flatnonzero(~certified)
    if len(left):
        ids[left], best[left], bounds[left], rest[left] = scan(x[left], c, ids.shape[1] - 1)
        depth[left] = ids.shape[1] - 1
    return ids, best, bounds, rest, depth


def _lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(a).ravel()))


def _matrix(column: pa.ListArray, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def cluster(vectors: DataFrame, k: int, rounds: int, size: int, scale: int, seed: int = 1, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    folder = f"{shared_folder(spark)}/centroids-{uuid.uuid4().hex}"
    key = F.col(f"`{vec_id}`")
    source = vectors.select(key.alias("vec_id"), whole(F.col(f"`{vector}`"), size, scale).alias("x")).where("x is not null")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    seeds = source.withColumnRenamed("vec_id", vec_id).select(hashed.alias("hash"), "x").orderBy("hash", "x").limit(k).collect()  # k rows
    kind = source.schema["vec_id"].dataType.simpleString()
    state_schema = f"vec_id {kind}, x array<int>, cluster int, distance bigint, near array<int>, bounds array<double>, rest double, depth int"
    c = np.array([r.x for r in seeds], np.int64).reshape(len(seeds), size)
    b, moved, state = max(1, k // 4), None, source

    for turn in range(rounds + 1):

        def assign(batches: Iterator[pa.RecordBatch], c: np.ndarray = c, moved: np.ndarray | None = moved, b: int = b) -> Iterator[pa.RecordBatch]:
            for whole_batch in batches:
                for first in range(0, whole_batch.num_rows, _BATCH):
                    batch = whole_batch.slice(first, _BATCH)
                    x = _matrix(batch.column(1), np.int64)
                    if moved is None:
                        near, distance, bounds, rest = scan(x, c, b)
                        depth = np.zeros(len(x), np.int32)
                    else:
                        near, bounds = _matrix(batch.column(4), np.int32), _matrix(batch.column(5), np.float64)
                        near, distance, bounds, rest, depth = reassign(x, c, moved, near, bounds, batch.column(6).to_numpy(), b)
                    arrays = [batch.column(0), batch.column(1), pa.array(near[:, 0]), pa.array(distance), _lists(near), _lists(bounds), pa.array(rest), pa.array(depth)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "x", "cluster", "distance", "near", "bounds", "rest", "depth"])

        last = turn == rounds
        path = f"{folder}/{turn}"
        made = state.mapInArrow(assign, state_schema)
        (made.select("vec_id", "cluster", "distance") if last else made).write.parquet(path)
        state = spark.read.parquet(path)
        if turn:
            delete_table(spark, f"{folder}/{turn - 1}")
        if last:
            break
        sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(size))).collect()  # k rows
        new = c.copy()
        for r in sums:
            new[r.cluster] = [r[f"s{i}"] // r.n for i in range(size)]
        shift = new - c
        # moves beyond what floats hold exactly are rounded up as well
        moved, c = _above((shift * shift).sum(axis=1)), new
        if turn:
            b = max(1, k // 8, min(b, max((r.depth for r in sums), default=0)))

    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: r.inertia for r in state.groupBy("cluster").agg(total.alias("inertia")).collect()}  # k rows
    fits = lambda v: int(v) if v is not None and v < 1 << 63 else None
    whole_sum = fits(sum(inertia.values()))
    sha = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    rows = [(j, fits(inertia.get(j)), whole_sum, sha[j]) for j in range(len(c))]
    facts = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))
    return state.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same rounds as DuckDB SQL, all distances in every round."""
    parts = [
        f"""
v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
e AS MATERIALIZED (SELECT vec_id, i, x[i] AS x FROM v, range(1, {size + 1}) r(i)),
s AS (SELECT x, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM v),
c0 AS MATERIALIZED (SELECT c, i, x[i] AS x FROM s, range(1, {size + 1}) r(i) WHERE c < {k})"""
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""
d{n} AS (SELECT e.vec_id, c.c, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS d FROM e JOIN c{n} c USING (i) GROUP BY ALL),
a{n} AS MATERIALIZED (SELECT vec_id, min({{'d': d, 'c': c}}) AS m FROM d{n} GROUP BY vec_id)"""
        )
        if n < rounds:
            parts.append(
                f"""
m{n} AS (SELECT m.c AS c, i, sum(x)::BIGINT AS sx, count(*) AS n FROM a{n} JOIN e USING (vec_id) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN m.n IS NULL THEN c.x ELSE (m.sx - ((m.sx % m.n) + m.n) % m.n) // m.n END AS x FROM c{n} c LEFT JOIN m{n} m USING (c, i))"""
            )
    return (
        "WITH"
        + ",".join(parts)
        + f""",
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, m.c::INTEGER AS cluster, m.d::BIGINT AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
  (sum(m.d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN h ON h.c = m.c"""
    )
