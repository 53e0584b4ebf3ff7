from pyspark.sql import functions as F

from docloom.operators.chunks import chunk_hierarchical
from docloom.operators.embed import embed_hash
from docloom.session import scratch_dir
from docloom.sources.index import Collection
from test_index import files


def _nodes(spark, n=40):
    text = F.expr("repeat(concat('wort', cast(id AS string), ' '), 60)")
    docs = spark.range(n).select(
        F.col("id").cast("string").alias("doc_id"), text.alias("text"),
        F.struct(
            F.lit("p").alias("file_path"), F.lit("d").alias("file_directory"), F.lit("f").alias("filename"), F.lit(1).alias("page_number")
        ).alias("metadata"),
    )
    return embed_hash(chunk_hierarchical(docs), dim=8)


def _staged(spark):
    from pathlib import Path

    return {p.name for p in Path(scratch_dir(spark), "docloom").glob("index-nodes-*")}


def test_staged_nodes_go_and_files_are_few_and_packed(spark, tmp_path):
    """The staged copy does not stay on the disk beside the segment; files are written without moving rows."""
    before = _staged(spark)
    index = Collection(spark, str(tmp_path), "c")
    index.rebuild(_nodes(spark).repartition(20), cells=4)
    index.add(_nodes(spark).repartition(20), batch="b")
    assert _staged(spark) == before
    written = [f for f in files(index) if f.name.endswith(".parquet")]
    assert 0 < len(written) <= 3 * 4 + 3
    assert all(f.name.endswith(".zstd.parquet") for f in written)
    assert index.count() == index.read().count() == 2 * _nodes(spark).count()


def test_ids_that_repeat_or_are_missing_are_added_once(spark, tmp_path):
    nodes = _nodes(spark)
    index = Collection(spark, str(tmp_path), "c")
    index.rebuild(nodes.where("doc_id < 10"), cells=2)
    missing = nodes.where("doc_id = 11").withColumn("node_id", F.lit(None).cast("string"))
    more = nodes.where("doc_id < 12").unionByName(nodes.where("doc_id >= 11")).unionByName(missing).unionByName(missing)
    index.add(more, dedupe=True)
    counted = index.read().groupBy("node_id").count()
    assert counted.where("count > 1").count() == 0 and counted.where("node_id IS NULL").count() == 1
    known = nodes.where("doc_id < 10 OR doc_id >= 11 OR doc_id < 12").select("node_id").distinct()
    assert counted.where("node_id IS NOT NULL").count() == known.count()
