"""Prefix forest against brute force."""

import math

import numpy as np
import pytest

from docloom.llm import forest


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, uid string, code string")


def rows_of(matrix, first=0):
    return [(first + i, [float(x) for x in v], 0, "x", "x") for i, v in enumerate(matrix)]


def exact(rows, query_id, k):
    own = dict((i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows)
    d = sorted((math.sqrt(((own[query_id] - v) ** 2).sum()), i) for i, v in own.items() if i != query_id)
    return d[:k]


def recall(found, rows, k=10):
    hit = total = 0
    for q in {r.query_id for r in found}:
        wanted = {i for _, i in exact(rows, q, k)}
        hit += len(wanted & {r.vec_id for r in found if r.query_id == q})
        total += len(wanted)
    return hit / total


def test_recall_and_order_without_structure(spark):
    rng = np.random.default_rng(1)
    rows = rows_of(rng.standard_normal((2500, 24)))
    found = forest.forest_search(table(spark, rows)).collect()
    assert len(found) == 25 * 10 and recall(found, rows) >= 0.9
    for q in (0, 1200):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        truth = {i: d for d, i in exact(rows, q, len(rows))}
        assert all(abs(truth[r.vec_id] - r.score) < 1e-12 for r in mine)


def test_clusters_stop_deep_and_blocks_split(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 64)
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((20, 16)) * 10
    rows = rows_of(np.concatenate([c + rng.standard_normal((60, 16)) for c in centers]))
    assert recall(forest.forest_search(table(spark, rows), share=0.2).collect(), rows) >= 0.9


def test_a_third_are_copies(spark):
    rng = np.random.default_rng(3)
    matrix = rng.standard_normal((600, 8))
    matrix[::3] = matrix[0]
    rows = rows_of(matrix)
    found = forest.forest_search(table(spark, rows)).collect()
    mine = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == 300)
    assert mine == [(k + 1, 3 * k, 0.0) for k in range(10)]


def test_odd_vectors_take_no_part(spark):
    rows = rows_of(np.eye(6)) + [
        (100, None, 0, "x", "x"), (101, [0.0] * 6, 0, "x", "x"), (102, [float("nan")] + [1.0] * 5, 0, "x", "x"),
        (103, [float("inf")] + [1.0] * 5, 0, "x", "x"), (104, [None] + [1.0] * 5, 0, "x", "x"), (None, [1.0] * 6, 0, "x", "x"),
        (200, [1.0] + [0.0] * 5, 0, "x", "x"), (200, [1.0] + [0.0] * 5, 0, "x", "x"), (105, [1.0, 2.0], 0, "x", "x"),
    ]
    found = forest.forest_search(table(spark, rows)).collect()
    assert {r.query_id for r in found} == {0, 200}
    assert [r.vec_id for r in sorted((r for r in found if r.query_id == 200), key=lambda r: r["rank"])] == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("rows", [[], [(0, None, 0, "x", "x")], [(0, [1.0, 2.0], 0, "x", "x")]])
def test_nothing_to_find(spark, rows):
    found = forest.forest_search(table(spark, rows))
    assert found.columns == ["query_id", "rank", "vec_id", "score"] and found.count() == 0
