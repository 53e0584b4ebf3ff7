import numpy as np
import pytest

from docloom.operators import knn as N


def brute(queries, nodes, k):
    out = {}
    for q, qv in queries:
        ranked = sorted((round(float(((qv - v) ** 2).sum()), 6), n) for n, v in nodes)
        out[q] = [(n, d) for d, n in ranked[:k]]
    return out


def frames(spark, queries, nodes):
    schema = "{} string, embedding array<float>"
    return (
        spark.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], schema.format("query_id")),
        spark.createDataFrame([(n, [float(x) for x in v]) for n, v in nodes], schema.format("node_id")).repartition(5),
    )


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.node_id, r.distance))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [n for n, _ in a[q]] == [n for n, _ in b[q]], q
        assert np.allclose([d for _, d in a[q]], [d for _, d in b[q]], atol=2e-6)


@pytest.fixture(scope="module")
def data():
    """Vectors with a third of all nodes equal and a third of all questions near them."""
    rng = np.random.default_rng(0)
    grid = lambda n: rng.integers(-8, 9, (n, 6)) / 8  # noqa: E731 - exact in float32, many ties
    vectors = np.vstack([grid(200), np.tile(grid(1), (100, 1))])
    rng.shuffle(vectors)
    nodes = [(f"n{i:04d}", v) for i, v in enumerate(vectors)]
    questions = np.vstack([grid(40), np.tile(vectors[:1], (20, 1))])
    return [(f"q{i:03d}", v) for i, v in enumerate(questions)], nodes


def test_strategies_equal_brute_force(spark, data, monkeypatch):
    queries, nodes = data
    q, n = frames(spark, queries, nodes)
    expected = brute(queries, nodes, 4)
    same(result(N.knn_scan(q, n, 4)), expected)
    same(result(N.knn_scan(q, n, 4, sample=3)), expected)
    monkeypatch.setattr(N, "BLOCK_NODES", 16)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 8)
    same(result(N.knn_blocks(q, n, 4)), expected)
    for cells in (1, 7, 64):
        same(result(N.knn_cells(q, *N.place(n, cells), 4, probes=cells)), expected)
    # More queries than the scan accepts: an error, not another algorithm.
    monkeypatch.setattr(N, "SCAN_BYTES", 6 * 8 * 10)
    with pytest.raises(ValueError, match="knn_blocks"):
        N.knn_scan(q, n, 4)


def test_null_vectors_are_near_nothing(spark, data):
    queries, nodes = data
    q, n = frames(spark, queries[:5], nodes[:20])
    expected = brute(queries[:5], nodes[:20], 4)
    q = spark.createDataFrame([("none", None)], q.schema).unionByName(q)
    n = spark.createDataFrame([("none", None)], n.schema).unionByName(n)
    for found in (N.knn_scan(q, n, 4), N.knn_blocks(q, n, 4), N.knn_cells(q, *N.place(n, 3), 4, probes=3)):
        same(result(found), expected)


def test_fewer_nodes_than_k(spark, data):
    queries, nodes = data
    q, n = frames(spark, queries, nodes[:3])
    expected = brute(queries, nodes[:3], 4)
    same(result(N.knn_scan(q, n, 4)), expected)
    same(result(N.knn_cells(q, *N.place(n, 2), 4, probes=2)), expected)


def test_no_queries(spark, data):
    q, n = frames(spark, *data)
    assert N.knn_scan(q.limit(0), n).count() == 0 and N.knn_blocks(q.limit(0), n).count() == 0


def test_self_query_is_first(spark, data):
    _, nodes = data
    unique = list({tuple(v): (n, v) for n, v in reversed(nodes)}.values())
    q, n = frames(spark, unique, unique)
    for query_id, hits in result(N.knn_scan(q, n, 1)).items():
        assert hits == [(query_id, 0.0)]


def test_probing_every_cell_is_exact(spark, data):
    queries, nodes = data
    q, n = frames(spark, queries, nodes)
    same(result(N.knn_cells(q, *N.place(n, 8), 4, probes=8)), brute(queries, nodes, 4))


def test_recall(spark, small):
    from docloom.plans import inputs

    q, n = inputs.questions(spark, small), inputs.nodes(spark, small)
    exact = N.knn_scan(q, n)
    row = N.recall(exact, exact).first()
    assert (row.n_hits, row.recall) == (2000, 1.0)
    placed = N.place(n)
    some = N.recall(N.knn_cells(q, *placed, probes=8), exact).first().recall
    default = N.recall(N.knn_cells(q, *placed), exact).first().recall
    assert 0.5 < some < 0.9 <= default


def test_blocks_stay_bounded(spark, data, monkeypatch):
    """However hot a cell is, no group of the cell join exceeds the block sizes by much."""
    queries, nodes = data
    q, n = frames(spark, queries, nodes)
    monkeypatch.setattr(N, "BLOCK_NODES", 20)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 10)
    seen = spark.sparkContext.accumulator(0)
    real = N._nearest

    def watched(a, b, k):
        if len(b) > 60 or len(a) > 40:
            seen.add(1)
        return real(a, b, k)

    monkeypatch.setattr(N, "_nearest", watched)
    N.knn_cells(q, *N.place(n, 1), 4).collect()
    N.knn_blocks(q, n, 4).collect()
    assert seen.value == 0
