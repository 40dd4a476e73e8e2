"""Centroid clustering in whole numbers with ns-bounds, exact in every round.

Each round is a Spark job over a table of vectors with their bounds; only centroids (k of them, for
each round) pass through the driver. For a vector and a centroid the table holds the distance
when it was last evaluated and the round of that. The centroids of all rounds are retained, so a
stored distance is loosened by the norm of the centroid's total displacement since that round:
one norm of a sum, never more than the sum of the norms of each round's drift.

A round evaluates the distance to a vector's own centroid, and then exactly to each other centroid whose
loosened bound does not exceed it (bounds are rounded down, so ties are always evaluated). The
nearest of these is the nearest of all; of equal ones the smaller number.

Defined cases: vectors that are null, of another size, or hold a null or a non-finite component are
left out; components beyond `LARGEST` are taken as that; a null vec_id is assigned but is no first centroid; rows of one id are vectors of
their own, and where several are among the first centroids they are ordered by their components; with
fewer vectors than k there are as many centroids as vectors; an empty table gives an empty result; only
vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import dropped, freeing, shared_path, written

K, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
LARGEST = 1 << 27  # of a component: the square of a distance then fits in 63 bits
EXACT = 1 << 21  # up to this magnitude, sums of SIZE squares are whole numbers in double precision
PAIRS = 1 << 16  # distances that are evaluated at once
_STATE = "vec_id long, v array<int>, cluster int, distance long, low array<float>, seen array<tinyint>, scanned int"


def whole_vectors(table: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding) -> vec_id, v: floor(scale * x) of each component of the vectors that count."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    part = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    return table.filter((F.size("embedding") == size) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", part).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors of the k least hashes of ``seed:vec_id``, in the order of their hashes."""
    hashed = vectors.filter("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    rows = hashed.orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def squared(v: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact squared distances of v[i] and c[j]."""
    out = np.empty(len(i), np.int64)
    exact = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0))) <= EXACT
    v, c = (v.astype(np.float64), c.astype(np.float64)) if exact else (v, c)
    for low in range(0, len(i), PAIRS):
        gap = v[i[low : low + PAIRS]] - c[j[low : low + PAIRS]]
        out[low : low + PAIRS] = np.einsum("ij,ij->i", gap, gap)
    return out


def assign(v: np.ndarray, own: np.ndarray, low: np.ndarray, seen: np.ndarray, history: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(cluster, distance, low, seen, distances evaluated) of vectors for the last centroids of ``history``.

    low[i, j] is a lower bound of the distance of vector i and centroid j as it stood in round seen[i, j].
    """
    now, c = len(history) - 1, history[-1]
    n, k = low.shape
    moved = np.stack([np.sqrt(((c - old).astype(np.float64) ** 2).sum(axis=1)) for old in history])
    each = np.arange(n)
    found = np.full((n, k), np.iinfo(np.int64).max)
    found[each, own] = squared(v, c, each, own)
    reach = np.sqrt(found[each, own].astype(np.float64))
    drift = moved[seen, np.arange(k)]
    scan = low - drift <= reach[:, None] + 1e-9 * (low + drift + 1)
    scan[each, own] = False
    i, j = np.nonzero(scan)
    found[i, j] = squared(v, c, i, j)
    scan[each, own] = True
    i, j = np.nonzero(scan)
    low, seen = low.copy(), seen.copy()
    low[i, j] = np.nextafter(np.sqrt(found[i, j].astype(np.float64)).astype(np.float32), np.float32(0))
    seen[i, j] = now
    cluster = found.argmin(axis=1)  # the first of equal ones
    return cluster, found[each, cluster], low, seen, scan.sum(axis=1)


def _round(history: list[np.ndarray]):
    k = len(history[0])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(n, -1)
            if batch.num_columns == 2:
                own, low, seen = np.zeros(n, np.int64), np.zeros((n, k), np.float32), np.zeros((n, k), np.int8)
            else:
                own = batch.column(2).to_numpy().astype(np.int64)
                low, seen = batch.column(3).flatten().to_numpy().reshape(n, k), batch.column(4).flatten().to_numpy().reshape(n, k)
            cluster, distance, low, seen, scanned = assign(v, own, low, seen, history)
            ends = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.ListArray.from_arrays(ends, pa.array(low.ravel())), pa.ListArray.from_arrays(ends, pa.array(seen.ravel())), pa.array(scanned.astype(np.int32))],
                names=["vec_id", "v", "cluster", "distance", "low", "seen", "scanned"],
            )

    return step


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each cluster's vectors; a row for each cluster comes to the driver."""
    size = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("v")[p].cast("long")).alias(f"s{p}") for p in range(size)))
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster] = [r[2 + p] // r.n for p in range(size)]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[np.ndarray]]:
    """vectors (vec_id, v) -> (vec_id, v, cluster, distance (squared), scanned (distances that the last round evaluated)), and the centroids of every round.

    Each round's table is written before the last one's is removed.
    """
    spark = vectors.sparkSession
    start = first_centroids(vectors, k, seed)
    if not len(start):
        return spark.createDataFrame([], _STATE).select("vec_id", "v", "cluster", "distance", "scanned"), []
    if rounds > 126:
        raise ValueError("rounds are numbered in a byte")
    history, state, path = [start], vectors.select("vec_id", "v"), None
    for r in range(rounds + 1):
        last, path = path, shared_path(spark, "means")
        given = state.select("vec_id", "v", *(["cluster", "low", "seen"] if r else []))
        state = written(given.mapInArrow(freeing(_round(list(history))), _STATE), "means", path)
        if last:
            dropped(spark, last)
        if r < rounds:
            history.append(moved(state, history[-1]))
    return state.select("vec_id", "v", "cluster", "distance", "scanned"), history


def _total(column: str):
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit((1 << 63) - 1)).cast("long")


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector."""
    spark = assigned.sparkSession
    named = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    by = assigned.groupBy("cluster").agg(_total("distance").alias("cluster_inertia"))
    whole = by.agg(_total("cluster_inertia").alias("inertia"))
    per = by.crossJoin(F.broadcast(whole)).join(F.broadcast(spark.createDataFrame(named, "cluster int, centroid_sha256 string")), "cluster")  # k rows by one
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_bounded_means(spark, sf_dir: str) -> DataFrame:
    """Every vector that counts, with its cluster."""
    from quillmesh.llm.common import table

    assigned, history = cluster(whole_vectors(table(spark, sf_dir, "embeddings")))
    return with_inertia(assigned, history[-1] if history else np.zeros((0, SIZE), np.int64))


def _oracle() -> str:
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {K}))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, CAST(best % 64 AS INTEGER) AS k, CAST(best // 64 AS BIGINT) AS d FROM (SELECT r, min(CAST(list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) * 64 + k) AS best FROM v, c{i} GROUP BY r))")
        if i < ROUNDS:
            parts.append(f"s{i} AS (SELECT k, p, sum(v[p]) AS s, count(*) AS n FROM a{i} JOIN v USING (r), unnest(range(1, {SIZE + 1})) AS u(p) GROUP BY k, p)")
            parts.append(f"m{i} AS (SELECT k, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY p) AS c FROM s{i} GROUP BY k)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    last = ROUNDS
    return f"""WITH {", ".join(parts)}
SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(list_transform(c, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{last} JOIN v USING (r) JOIN c{last} USING (k)"""


OP12_ORACLE = _oracle()
