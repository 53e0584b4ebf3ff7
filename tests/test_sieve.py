"""Fetching and writing nodes without moving or holding what is not needed."""

from pathlib import Path

from pyspark.sql import functions as F

from docloom.operators import citations as A
from docloom.operators import knn as N
from docloom.operators.sieve import sieve
from docloom.sources import index as I
from docloom.sources.index import Collection
from test_index_writes import _nodes


def test_a_sieve_keeps_all_asked_rows_and_few_others(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("node_id"), F.lit("t").alias("text"))
    ids = rows.where("cast(node_id AS int) % 100 = 3").select(F.col("node_id").alias("id"))
    left = sieve(rows, "node_id", ids)
    assert left.columns == rows.columns
    assert left.join(ids.withColumnRenamed("id", "node_id"), "node_id").count() == 200
    assert left.count() < 3_000
    assert sieve(rows, "node_id", ids.limit(0)).count() == 0


def test_metadata_moves_few_texts_that_no_query_hit(spark):
    """The nodes go through the sketch before the join, and repeated ids stay repeated."""
    hits = spark.createDataFrame([(1, "n1"), (2, "n1"), (2, "n3")], "query_id long, node_id string")
    nodes = spark.createDataFrame([("n1", "a"), ("n1", "b"), ("n2", "c"), ("n3", "d"), (None, "e")], "node_id string, text string")
    found = A.hits_with_metadata(hits, nodes)
    assert sorted(map(tuple, found.collect())) == [("n1", 1, "a"), ("n1", 1, "b"), ("n1", 2, "a"), ("n1", 2, "b"), ("n3", 2, "d")]
    assert "BroadcastHashJoin" in found._jdf.queryExecution().simpleString() and "_bits" in found._jdf.queryExecution().simpleString()


def test_staged_files_go_slice_by_slice(spark, tmp_path, monkeypatch):
    """When the last slice is written, the staged rows of the others are gone; all rows arrive once."""
    nodes = _nodes(spark).repartition(12)
    monkeypatch.setattr(I, "TASK_BYTES", 1)
    seen, write = [], Collection._write_nodes

    def watched(self, rows, segment, size, cells):
        staged = Path(rows.inputFiles()[0].removeprefix("file:")).parent
        seen.append(len(list(staged.glob("*.parquet"))))
        return write(self, rows, segment, size, cells)

    monkeypatch.setattr(Collection, "_write_nodes", watched)
    index = Collection(spark, str(tmp_path), "c")
    index.rebuild(nodes.where("doc_id < 30"), cells=2)
    assert len(seen) > 2 and seen == sorted(seen, reverse=True) and seen[-1] < seen[0]
    index.add(nodes.where("doc_id >= 30"), batch="b")
    assert index.count() == index.read().count() == nodes.count()
    assert index.read().exceptAll(nodes.select(*index.read().columns)).count() == 0


def test_queries_go_to_no_more_blocks_than_there_are_cores():
    grid = N._grid({0: (100_000, 64)}, {0: (3_400_000, 64)}, 12)
    assert grid[0][:2] == (1, 12)
