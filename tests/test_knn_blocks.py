import numpy as np

from docloom.operators import knn as N
from test_knn import brute, frames, result, same


def test_blocks_follow_the_memory_of_a_task_not_the_pairs():
    """A query goes to every node block and a node to every query block, so both must be few."""
    n_queries, n_nodes, cores = 95_000, 2_900_000, 12
    a, b, _ = N._grid({0: (n_queries, 64)}, {0: (n_nodes, 64)}, cores)[0]
    assert n_queries * b + n_nodes * a < 3 * (n_queries + n_nodes)
    a, b, _ = N._grid({0: (6 * n_queries, 64)}, {0: (6 * n_nodes, 64)}, cores)[0]
    assert 6 * (n_queries * b + n_nodes * a) < 4 * 6 * (n_queries + n_nodes)
    # Longer vectors make smaller blocks; a cell that no query asks for makes none.
    assert N._grid({0: (1 << 18, 1024)}, {0: (1000, 1024), 3: (5, 1024)}, cores) == {0: (16, 1, 0)}


def test_running_nearest_equals_brute_force(spark):
    """Many batches of nodes, of unlike lengths, nodes far apart and the same one twice."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 5)).astype(np.float32) * rng.choice([0.01, 1, 300], (3000, 1)).astype(np.float32)
    vectors[1500:1600] = vectors[:100]
    best = N._Nearest(vectors[:1100], 6)
    for part in (vectors[:3], vectors[3:1400], vectors[1400:]):
        best.add(part)
    r, c, d = best.hits()
    assert np.array_equal(np.bincount(r), np.full(1100, 6))
    wide = vectors.astype(np.float64)
    for q in range(0, 1100, 37):
        exact = np.round(((wide - wide[q]) ** 2).sum(axis=1), 6)
        assert np.allclose(d[r == q], np.sort(exact)[:6], rtol=1e-9, atol=2e-6)
        assert np.allclose(exact[c[r == q]], d[r == q], rtol=1e-9, atol=2e-6)


def test_fewer_nodes_than_hits(spark):
    queries = [(f"q{i}", v) for i, v in enumerate(np.eye(3))]
    nodes = [("b", np.ones(3)), ("a", np.ones(3))]
    q, n = frames(spark, queries, nodes)
    same(result(N.knn_blocks(q, n, 5)), brute(queries, nodes, 5))
