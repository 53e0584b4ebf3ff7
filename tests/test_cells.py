import numpy as np
import pytest

from docloom.operators import cells as C
from docloom.operators import knn


def frame(spark, matrix, key, first=0):
    rows = [(f"{first + i:05d}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} string, embedding array<float>")


def clustered(seed, groups=30, each=60, dims=24):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((groups, dims)) * 6
    return np.concatenate([c + rng.standard_normal((each, dims)) for c in centers])


def test_lloyd_finds_groups():
    matrix = clustered(1, groups=8, each=50, dims=5)
    found = C.lloyd(matrix, 8, steps=20)
    home = C._squared(matrix, found).argmin(axis=1).reshape(8, 50)
    assert len({row[0] for row in home if len(set(row)) == 1}) >= 5
    assert len(C.lloyd(np.ones((9, 3)), 4)) == 1  # one distinct row, one centroid


@pytest.mark.parametrize("one_level", [256, 8])
def test_recall_on_clusters_reads_a_quarter_at_most(spark, monkeypatch, one_level):
    monkeypatch.setattr(C, "ONE_LEVEL", one_level)
    matrix = clustered(2)
    nodes, asked = frame(spark, matrix, "node_id"), frame(spark, matrix[::7] + 0.01, "query_id")
    model = C.fit(nodes, cells=36, total=len(matrix), fit_rows=32)
    assert 25 <= len(model) <= 42
    placed = C.with_cells(nodes, model).cache()
    found = C.lookup(asked, placed, model, k=4, probes=4)
    row = knn.recall(found, knn.knn_blocks(asked, nodes, 4)).first()
    read = C.share_read(asked, placed, model, probes=4).first()
    assert row.recall >= 0.9 and read.n_nodes == len(matrix) and read.share <= 0.25


def test_distances_are_exact_and_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(3)
    matrix = np.round(rng.standard_normal((300, 10)), 2)
    matrix[::3] = matrix[0]  # a third are copies
    nodes, asked = frame(spark, matrix, "node_id"), frame(spark, matrix[:6], "query_id")
    model = C.fit(nodes, cells=4)
    placed = C.with_cells(nodes, model)
    found = C.lookup(asked, placed, model, k=5, probes=4, rerank=1000).collect()
    assert sorted(map(str, found)) == sorted(map(str, knn.knn_blocks(asked, nodes, 5).collect()))
    assert [r.node_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == "00000"] == [f"{i:05d}" for i in (0, 3, 6, 9, 12)]


def test_hot_cells_are_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_NODES", 16)
    monkeypatch.setattr(C, "BLOCK_QUERIES", 8)
    matrix = clustered(4, groups=2, each=100, dims=6)
    nodes, asked = frame(spark, matrix, "node_id"), frame(spark, matrix[:40], "query_id")
    model = C.fit(nodes, cells=2)
    found = C.lookup(asked, C.with_cells(nodes, model), model, k=4, probes=2, rerank=500)
    assert sorted(map(str, found.collect())) == sorted(map(str, knn.knn_blocks(asked, nodes, 4).collect()))


def test_model_survives_its_table(spark):
    model = C.fit(frame(spark, clustered(5, groups=4, each=30, dims=7), "node_id"), cells=5)
    again = C.Cells.of_rows(model.rows(spark))
    assert (again.centroids == model.centroids).all() and (again.books == model.books).all()
    assert model.books.shape == (1, C.WORDS, C.PART)


def test_null_vectors_and_nothing(spark):
    nodes = frame(spark, clustered(6, groups=2, each=5, dims=3), "node_id")
    odd = nodes.unionByName(spark.createDataFrame([("none", None)], nodes.schema))
    asked = frame(spark, np.zeros((2, 3)), "query_id").unionByName(spark.createDataFrame([("none", None)], "query_id string, embedding array<float>"))
    model = C.fit(odd, cells=3)
    placed = C.with_cells(odd, model)
    found = C.lookup(asked, placed, model, k=3, probes=3, rerank=100)
    assert {r.query_id for r in found.collect()} == {"00000", "00001"} and "none" not in {r.node_id for r in found.collect()}
    assert placed.where("node_id = 'none'").select("cell", "code").first() == (0, None)
    empty = nodes.limit(0)
    assert C.fit(empty) is None
    nothing = C.lookup(asked, C.with_cells(empty, None), None)
    assert nothing.columns == ["query_id", "node_id", "distance", "rank"] and nothing.count() == 0


def test_codes_near_many_queries_are_found_together():
    """The smallest values of each row, ties to the first columns, as a stable sort of each row gives them."""
    rng = np.random.default_rng(3)
    near = rng.integers(0, 6, (40, 30)) / 2
    for keep in (1, 7, 30, 64):
        r, c, d = C._best(near, keep)
        wanted = np.argsort(near, axis=1, kind="stable")[:, :keep]
        assert np.array_equal(c.reshape(40, -1), wanted) and np.array_equal(d.reshape(40, -1), np.take_along_axis(near, wanted, 1))
        assert np.array_equal(r, np.repeat(np.arange(40), wanted.shape[1]))


def test_distances_to_codes_equal_sums_over_parts():
    rng = np.random.default_rng(4)
    model = C.Cells(rng.normal(size=(2, 11)), rng.normal(size=(3, 5, 4)))
    queries, codes = rng.normal(size=(6, 11)), rng.integers(0, 5, (9, 3)).astype(np.uint8)
    near = model.near(queries, 1, codes)
    rest = np.hstack([queries - model.centroids[1], np.zeros((6, 1))]).reshape(6, 3, 4)
    for i in range(6):
        for j in range(9):
            assert np.isclose(near[i, j], sum(((rest[i, p] - model.books[p, codes[j, p]]) ** 2).sum() for p in range(3)))
