"""Clustering with a pivot table against plain comparison with every centroid."""

import hashlib
import math
import struct
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from check_queries import rows_of
from offerflow.llm import pivot_clusters, queries

SF = "/root/testdata/sf0.001"


def brute(rows, k=40, rounds=5, size=64):
    kept = []
    for vec_id, v in rows:
        if v is None or len(v) != size or any(x is None or not math.isfinite(x) or abs(x) >= 524288 for x in v):
            continue
        kept.append((vec_id, [math.floor(256 * x) for x in v]))

    def name(r):
        return (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "")

    centroids = [r[1] for r in sorted(kept, key=name)[:k]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        which = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (w, _) in zip(kept, which) if w == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    which, inertia = assign(), Counter()
    for c, d in which:
        inertia[c] += d
    return Counter(
        (vec_id, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (vec_id, _), (c, d) in zip(kept, which))


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [single(x) for x in rng.normal(0, 0.3, 4) + (i % 3)]) for i in range(150)]
    rows += rows[:20] + [rows[5]] * 30  # repeated rows
    rows += [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 0.0, 0.0]), (904, [1.0] * 5),
             (905, [math.nan, 0.0, 0.0, 0.0]), (906, [math.inf, 0.0, 0.0, 0.0]), (907, [1e30, 0.0, 0.0, 0.0]),
             (908, [-524287.0, 524287.0, 0.0, 1.0]), (909, [0.0] * 4), (910, [0.0] * 4), (911, [-0.001] * 4), (None, [0.5] * 4)]
    return rows


def test_odd_vectors(spark):
    rows = odd_vectors()
    table = spark.createDataFrame([(a, b, 7, 1.0, "x") for a, b in rows],
                                  "vec_id long, embedding array<float>, cluster int, v double, p string")
    for k, rounds, pivots in ((7, 3, 3), (400, 1, 16)):
        got = pivot_clusters.cluster(table, k, rounds, 4, n_pivots=pivots).drop("centroid")
        assert Counter(map(tuple, got.collect())) == brute(rows, k, rounds, 4)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    got = pivot_clusters.cluster(empty)
    assert got.collect() == [] and got.columns[:3] == ["vec_id", "cluster", "distance"]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(1, 9), st.integers(1, 6), st.sampled_from([3, 1000, (1 << 27) - 1]))
def test_bounds_lose_nothing(seed, k, n_pivots, reach):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-reach, reach, (60, 5), endpoint=True)
    centroids = rng.integers(-reach, reach, (k, 5), endpoint=True)
    pivots = pivot_clusters.spread_pivots(vectors[:20], n_pivots)
    far = np.sqrt(np.stack([pivot_clusters.exact(vectors, p) for p in pivots], axis=1).astype(float))
    which, distance, _ = pivot_clusters.nearest_centroids(vectors, far, pivots, centroids)
    every = np.stack([pivot_clusters.exact(vectors, c) for c in centroids], axis=1)
    assert (which == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (40, 64))
    vectors = np.concatenate([c + rng.integers(-60, 60, (50, 64)) for c in centres])
    pivots = pivot_clusters.spread_pivots(centres, 16)
    far = np.sqrt(np.stack([pivot_clusters.exact(vectors, p) for p in pivots], axis=1).astype(float))
    _, _, taken = pivot_clusters.nearest_centroids(vectors, far, pivots, centres)
    assert taken < len(vectors) * 2  # of 40 a vector


def test_query_and_its_twin(spark):
    got = queries.op12_pivot_clusters(spark, SF)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert Counter(map(tuple, got.collect())) == brute([tuple(r) for r in rows])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    cur = con.execute(queries.ORACLES["op12_pivot_clusters"])
    assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_vectors_are_integers(spark):
    row = spark.createDataFrame([([0.5, -0.001, 0.0],)], "v array<double>").select(
        pivot_clusters.integer_vector(F.col("v"), 3).alias("v")).first()
    assert row["v"] == [128, -1, 0]
