"""Clusters against plain Python, in which every distance is computed anew."""

import hashlib
import math
import random

import numpy as np
import pytest

from palimpsest.llm import dot_clusters as dc


def plain(vectors, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        to = assigned()
        for n in range(len(centroids)):
            if own := [v for (_, v), (_, c) in zip(kept, to) if c == n]:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    to = assigned()
    total = sum(d for d, _ in to)
    return sorted((i, c, d, sum(e for e, b in to if b == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                  for (i, _), (d, c) in zip(kept, to))


def run(df):
    return sorted(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "7 as cluster", "'x' as v", "1 as dots", "2 as distance")


def test_clusters(spark):
    rng = random.Random(1)

    def vector(n=64):
        return [float(np.float32(rng.uniform(-1, 1))) for _ in range(n)]

    rows = [(i, vector()) for i in range(200)]
    rows += rows[:20] + [(300 + i, rows[0][1]) for i in range(100)]  # repeated rows, many copies of one vector
    rows += [(500, None), (501, []), (502, vector(63)), (503, vector(65)), (504, [None, *vector(63)]), (505, [math.nan, *vector(63)]),
             (506, [math.inf, *vector(63)]), (507, [1000.0] * 64)]
    assert run(dc.clustered_embeddings(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert run(dc.clustered_embeddings(frame(spark, rows))) == plain(rows)


def test_no_id(spark):
    rows = [(None, [0.5] * 64), (3, [0.25] * 64)]
    found = dc.clustered_embeddings(frame(spark, rows)).collect()
    assert sorted((r["vec_id"] is None, r["distance"]) for r in found) == [(False, 0), (True, 0)]


def test_too_large(spark):
    with pytest.raises(Exception, match="beyond"):
        dc.clustered_embeddings(frame(spark, [(1, [3e38] * 64)])).collect()


def test_products_follow_changes(spark):
    """Dot products carried through the rounds are those of the last centroids."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(300)]
    state, centroids = dc.cluster(dc.whole_vectors(frame(spark, rows)))
    for r in state.collect():
        assert r["dots"] == (centroids @ np.array(r["v"])).tolist()
