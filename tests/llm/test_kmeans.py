"""Heap-ordered bounds against plain rounds over all pairs."""

import hashlib
import math

import numpy as np
import pytest

from docloom.llm import kmeans

SCHEMA = "vec_id long, embedding array<float>, label int, point string, cluster string, part string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA)


def plain(rows, dims, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    ids, matrix = [i for i, _ in kept], np.array([v for _, v in kept], dtype=object)

    def assign():
        d = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for v in matrix]
        return [min(range(len(centroids)), key=lambda c: (x[c], c)) for x in d], d

    for _ in range(rounds):
        home, _ = assign()
        for c in range(len(centroids)):
            own = [v for v, h in zip(matrix, home) if h == c]
            if own:
                centroids[c] = [int(sum(col)) // len(own) for col in zip(*own)]
    home, d = assign()
    best = [int(x[h]) for x, h in zip(d, home)]
    each = {c: sum(b for b, h in zip(best, home) if h == c) for c in set(home)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, h, b, each[h], sum(best), sha[h]) for i, h, b in zip(ids, home, best)]


def same(found, expected):
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("rounds", [0, 1, 3, 9])
def test_equals_plain_rounds(spark, rounds):
    rng = np.random.default_rng(rounds)
    centers = rng.standard_normal((20, 6)) * 3
    rows = [(i, [float(x) for x in centers[i % 20] + rng.standard_normal(6)]) for i in range(700)]
    same(kmeans.cluster(table(spark, rows).repartition(5), dims=6, rounds=rounds), plain(rows, 6, rounds=rounds))


def test_ties_go_to_the_smaller_number(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 64]) for i in range(500)]
    same(kmeans.cluster(table(spark, rows).repartition(4), dims=4), plain(rows, 4))


def test_a_third_are_copies(spark):
    rng = np.random.default_rng(9)
    matrix = rng.standard_normal((600, 8))
    matrix[::3] = matrix[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    same(kmeans.cluster(table(spark, rows).repartition(3), dims=8), plain(rows, 8))


def test_few_are_compared_again(spark, monkeypatch):
    """Vectors near their centroid outlast the drift of the rounds."""
    rng = np.random.default_rng(10)
    vectors = np.repeat(np.eye(8) * 6400, 50, axis=0).astype(np.int64) + rng.integers(-50, 50, (400, 8))
    centroids = vectors[::50].copy()
    home, gap = kmeans.nearest(vectors, centroids)
    heaps = kmeans.Heaps([[] for _ in range(8)])
    heaps.push(range(400), home, gap, np.zeros(8))
    moved = centroids + rng.integers(-20, 20, centroids.shape)
    drift = kmeans.expiry_offsets(np.sqrt(((moved - centroids) ** 2).sum(axis=1)))
    assert heaps.expired(drift) == ([], [])
    assert (kmeans.nearest(vectors, moved)[0] == home).all()


def test_odd_vectors(spark):
    good = [(i, [float(i % 7), float(i % 3), -0.01]) for i in range(30)]
    odd = [
        (40, None), (41, []), (42, [1.0, 2.0]), (43, [1.0, None, 2.0]), (44, [1.0, float("nan"), 2.0]),
        (45, [float("inf"), 0.0, 0.0]), (46, [float("-inf"), 0.0, 0.0]), (47, [1.0] * 4),
    ]
    repeated = [(3, good[3][1]), (3, good[3][1]), (None, [0.5, 0.5, 0.5])]
    rows = good + odd + repeated
    same(kmeans.cluster(table(spark, rows), dims=3), plain(rows, 3))


def test_components_beyond_the_limit(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 0.0])]
    found = kmeans.cluster(table(spark, rows), k=1, dims=2, rounds=0).collect()
    first = min((1, 2, 3), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())
    x = {1: kmeans.LIMIT, 2: -kmeans.LIMIT, 3: 0}
    assert {r.vec_id: r.distance for r in found} == {i: (x[i] - x[first]) ** 2 for i in x}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_cluster(spark, rows):
    found = kmeans.cluster(table(spark, rows), dims=2)
    assert found.columns[0] == "vec_id" and found.count() == 0


def test_fewer_vectors_than_clusters(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)]
    same(kmeans.cluster(table(spark, rows), dims=2), plain(rows, 2))
