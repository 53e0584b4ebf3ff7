"""What the exact search and the index move: packs of rows, files by task."""

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import embed as E
from docloom.operators import knn as N
from docloom.sources import index as I
from test_index import files
from test_index_writes import _nodes
from test_knn import brute, frames, result, same


def test_rows_are_moved_in_packs(spark, monkeypatch):
    """A task sends each block few compressed packs; they hold its rows as they were."""
    monkeypatch.setattr(N, "PACK_BYTES", 1 << 17)
    text = F.expr("concat('wort ', cast(id % 97 AS string), ' und ', cast(id % 89 AS string))")
    rows = E.embed_hash(spark.range(0, 3000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("node_id"), text.alias("text")))
    rows = rows.select("node_id", "embedding", F.lit(0).alias("cell"), F.pmod(F.xxhash64("node_id"), F.lit(3)).alias("block"))
    packs = N._packed(rows, "node_id").collect()
    wanted = {(r.block, r.node_id): r.embedding for r in rows.collect()}
    got = {}
    for p in packs:
        ids, vectors = N._unpacked([(p.n, bytes(p.rows))])
        got |= {(p.block, i): v for i, v in zip(ids.to_pylist(), vectors.tolist())}
    assert got == wanted
    assert 3 <= len(packs) < 60 and sum(p.n for p in packs) == 3000
    assert sum(len(p.rows) for p in packs) < 3000 * (64 + 4 * 64) / 2


def test_several_packs_are_opened_in_order(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], 0, i % 2) for i in range(10)], "query_id long, embedding array<float>, cell int, block long")
    packs = [(p.n, bytes(p.rows)) for p in N._packed(rows.coalesce(1), "query_id").orderBy("block").collect()]
    ids, vectors = N._unpacked(list(packs))
    assert sorted(ids.to_pylist()) == list(range(10)) and [v[0] for v in vectors.tolist()] == [float(i) for i in ids.to_pylist()]


def test_equal_nodes_tie_by_id_across_packs(spark, monkeypatch):
    monkeypatch.setattr(N, "PACK_BYTES", 1)
    nodes = spark.createDataFrame([(f"n{i:03d}", [1.0, 2.0]) for i in reversed(range(40))], "node_id string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>")
    hits = N.knn_blocks(queries, nodes, 3).orderBy("rank").collect()
    assert [h.node_id for h in hits] == ["n000", "n001", "n002"]


def test_additions_are_written_by_more_tasks_than_rebuilds(spark, monkeypatch, tmp_path):
    """A loose segment has few folders, so its tasks may be smaller."""
    monkeypatch.setattr(I, "LOOSE_BYTES", 1 << 12)
    index = I.Collection(spark, str(tmp_path), "c")
    index.rebuild(_nodes(spark, 400).repartition(8), cells=2)
    index.add(_nodes(spark, 400).repartition(8), batch="b")
    assert len(files(index, "nodes")) <= 3 * 2 < len(files(index, "loose"))
    assert index.count() == index.read().count()


def test_a_text_that_comes_again_is_counted_once():
    class Counting(E.Buckets):
        asked = 0

        def __getitem__(self, token):
            Counting.asked += 1
            return super().__getitem__(token)

    found = Counting(8).vectors([b"a b", b"c", b"a b", b"a b"])
    assert Counting.asked == 3 and np.array_equal(found[0], found[2]) and np.array_equal(found[0], found[3])


def _many_alike():
    """Nodes of few vectors, many of one, some ids twice, and questions that come several times."""
    rng = np.random.default_rng(5)
    few = rng.integers(-4, 5, (30, 3)) / 4
    vectors = np.vstack([few[rng.integers(0, 30, 400)], np.tile(few[:1], (300, 1))])
    nodes = [(f"n{i % 650:03d}", v) for i, v in enumerate(vectors)]
    return [(f"q{i:02d}", few[i % 11]) for i in range(44)], [nodes[i] for i in rng.permutation(len(nodes))]


def test_equal_vectors_are_compared_once_with_the_same_hits(spark, monkeypatch):
    queries, nodes = _many_alike()
    askers, ids = [q for q, _ in queries], [n for n, _ in nodes]
    rows = lambda pairs: np.array([v for _, v in pairs], np.float32)
    compared = []
    add = N._Nearest.add
    monkeypatch.setattr(N._Nearest, "add", lambda self, part: (compared.append((len(self.queries), len(part))), add(self, part))[1])
    r, c, d = N._block_hits(N.pa.array(askers), rows(queries), N.pa.array(ids), rows(nodes), 5)
    got = {}
    for q, n, x in zip(r, c, d):
        got.setdefault(askers[q], []).append((ids[n], x))
    assert got == brute(queries, nodes, 5)
    assert compared == [(11, len(np.unique(rows(nodes), axis=0)))]
    for blocks in (16, 1 << 19):
        monkeypatch.setattr(N, "BLOCK_NODES", blocks)
        same(result(N.knn_blocks(*frames(spark, queries, nodes), 5)), brute(queries, nodes, 5))


def test_a_task_sends_a_frequent_vector_k_times(spark):
    _, nodes = _many_alike()
    n = frames(spark, [], nodes)[1].coalesce(1).select("*", F.lit(0).alias("cell"), F.lit(0).cast("long").alias("block"))
    pack, = N._packed(n, "node_id", 3).collect()
    ids, vectors = N._unpacked([(pack.n, bytes(pack.rows))])
    left = {}
    for i, v in zip(ids.to_pylist(), vectors.tolist()):
        left.setdefault(tuple(v), []).append(i)
    every = {}
    for i, v in nodes:
        every.setdefault(tuple(v), []).append(i)
    assert {v: sorted(i) for v, i in left.items()} == {v: sorted(i)[:3] for v, i in every.items()}


def test_flags_are_found_eight_at_a_time():
    rng = np.random.default_rng(2)
    for n in (0, 5, 8, 1000, 4099):
        flags = rng.random(n) < 0.05
        assert np.array_equal(N._places(flags), np.flatnonzero(flags))
