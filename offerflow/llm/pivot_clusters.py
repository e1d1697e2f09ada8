"""Centroid clustering of integer vectors with a LAESA pivot table.

The distance of every vector to a few fixed pivots is worked out once and stored beside it. In
every round the triangle inequality over these pivots gives a lower bound for its distance to each
centroid; the most promising centroid gets an exact integer distance first, and only centroids whose
bound does not exceed it get one as well. The result is that of comparing with all of them.

Vectors stay where they lie: a round is one scan, and only a sum per task and cluster moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerflow.session import stage

#: Steps per unit of a component.
SCALE = 256
#: Components are integers below this size, so that no squared distance leaves 63 bits.
LARGEST = 1 << 27
PIVOTS = 16
#: Slack of a lower bound, as a share of the distances it comes from; roundings are far smaller.
SLACK = 1e-9


def integer_vector(vector: Column, size: int) -> Column:
    """floor(256 x) per component, or null if the vector is not to be clustered: another
    number of components, a null or non-finite one, or one of 2^27 steps or more."""
    steps = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    x = F.transform(vector, lambda v: v.cast("double"))
    fits = F.forall(x, lambda v: F.coalesce(F.abs(v) < LARGEST / SCALE, F.lit(False)) & ~F.isnan(v))
    return F.when(F.coalesce((F.size(vector) == size) & fits, F.lit(False)), steps)


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """Rows of a binary column of fixed width."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def exact(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors to one point, exact."""
    apart = vectors - point
    return np.einsum("ij,ij->i", apart, apart)


def spread_pivots(vectors: np.ndarray, number: int) -> np.ndarray:
    """Pivots far from each other: the first vector, then always the one whose nearest pivot is
    farthest (the first of equals)."""
    chosen, nearest = [0], exact(vectors, vectors[0])
    while len(chosen) < min(number, len(vectors)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, exact(vectors, vectors[chosen[-1]]))
    return vectors[chosen]


def nearest_centroids(vectors: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray,
                      centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, the smaller of equals; its squared distance; how many
    exact distances that took)."""
    n, k = len(vectors), len(centroids)
    between = np.sqrt(np.stack([exact(centroids, p) for p in pivots], axis=1).astype(float))
    bounds = np.zeros((n, k))
    for p in range(len(pivots)):
        apart = to_pivots[:, p, None] - between[None, :, p]
        reach = to_pivots[:, p, None] + between[None, :, p]
        np.maximum(bounds, np.abs(apart) - SLACK * (reach + 1), out=bounds)
    first = bounds.argmin(axis=1)
    apart = vectors - centroids[first]
    best, which, taken = np.einsum("ij,ij->i", apart, apart), first.copy(), n
    for c in range(k):
        open_ = np.flatnonzero((bounds[:, c] <= np.sqrt(best.astype(float)) * (1 + SLACK)) & (first != c))
        if not len(open_):
            continue
        taken += len(open_)
        distance = exact(vectors[open_], centroids[c])
        wins = (distance < best[open_]) | ((distance == best[open_]) & (c < which[open_]))
        best[open_[wins]], which[open_[wins]] = distance[wins], c
    return which, best, taken


def pivot_table(vectors: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """The vectors (vec_id, v: array) as written table of vec_id, v (packed 32-bit integers) and p
    (packed distances to the pivots)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, size).astype(np.int64)
            far = np.sqrt(np.stack([exact(rows, p) for p in pivots], axis=1).astype("<f8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in rows.astype("<i4")], pa.binary()),
                 pa.array([r.tobytes() for r in far], pa.binary())], names=["vec_id", "v", "p"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return stage(vectors.mapInArrow(pack, f"vec_id {kind}, v binary, p binary"), "pivot-table")


def _round(table: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors, the same if none."""
    k, size = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            vectors = _matrix(batch.column(0), "<i4", size).astype(np.int64)
            which, _, _ = nearest_centroids(vectors, _matrix(batch.column(1), "<f8", len(pivots)), pivots, centroids)
            here = np.bincount(which, minlength=k)
            some = np.flatnonzero(here)
            if len(some):
                ordered = vectors[np.argsort(which, kind="stable")]
                total[some] += np.add.reduceat(ordered, (np.cumsum(here) - here)[some], axis=0)
            count += here
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(count[some]), *[pa.array(total[some, j]) for j in range(size)]],
            names=["c", "n", *[f"s{j}" for j in range(size)]])

    parts = table.select("v", "p").mapInArrow(sums, "c int, n long, " + ", ".join(f"s{j} long" for j in range(size)))
    rows = parts.groupBy("c").agg(F.sum("n").alias("n"), *[
        F.sum(F.col(f"s{j}").cast("decimal(20,0)")).alias(f"s{j}") for j in range(size)]).collect()
    after = centroids.copy()
    for r in rows:  # one row per cluster
        after[r["c"]] = [int(r[f"s{j}"]) // r["n"] for j in range(size)]
    return after


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, salt: str = "2",
            vec_id: str = "vec_id", vector: str = "embedding", n_pivots: int = PIVOTS) -> DataFrame:
    """One row per clustered vector: vec_id, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256, centroid (components).

    A vector is clustered if it has ``size`` components, none null, non-finite or so large that
    its distances would not fit a long (524,288 or more); others give no row. The first centroids are the
    ``k`` vectors with the smallest hash of salt and id, equal ones by their components, null
    ids last; with fewer vectors there are as many centroids. Ties go to the smaller number;
    repeated rows count and are returned each; an empty table gives no rows; a sum of distances
    beyond a long is null. The driver holds the centroids, and nothing that grows with the
    vectors; pivots are taken from the first centroids."""
    kept = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"),
                          integer_vector(F.col(f"`{vector}`"), size).alias("v")).filter("v IS NOT NULL")
    named = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    firsts = kept.orderBy(named.asc_nulls_last(), F.col("v").cast("string")).limit(k).collect()
    shape = "vec_id {}, cluster int, distance long".format(kept.schema["vec_id"].dataType.simpleString())
    if not firsts:
        return _described(kept.sparkSession.createDataFrame([], shape), [], vec_id)
    centroids = np.array([r["v"] for r in firsts], dtype=np.int64)
    pivots = spread_pivots(centroids, n_pivots)
    table = pivot_table(kept, pivots, size)
    for _ in range(rounds):
        centroids = _round(table, pivots, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), "<i4", size).astype(np.int64)
            which, distance, _ = nearest_centroids(rows, _matrix(batch.column(2), "<f8", len(pivots)), pivots, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(which, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return _described(stage(table.mapInArrow(assign, shape), "clusters"), centroids.tolist(), vec_id)


def _described(assigned: DataFrame, centroids: Sequence[Sequence[int]], vec_id: str) -> DataFrame:
    """Adds what holds for a whole cluster, a literal row for each of the k centroids."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia, whole = {r["cluster"]: int(r["s"]) for r in sums}, sum(int(r["s"]) for r in sums)

    def fits(x: int) -> int | None:
        return x if x < 1 << 63 else None

    rows = [(c, fits(inertia.get(c, 0)), fits(whole), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest(), v)
            for c, v in enumerate(centroids)]
    table = assigned.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return assigned.join(F.broadcast(table), "cluster").select(
        F.col("vec_id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
