import re

import pytest
from pyspark.sql import functions as F

from docloom.operators.chunks import chunk_hierarchical
from docloom.operators.embed import embed_hash
from docloom.operators import cells, knn
from docloom.sources import index as I
from docloom.sources.index import Collection, reconcile


@pytest.fixture(scope="module")
def nodes(spark):
    docs = spark.range(20).select(
        F.concat(F.lit("d"), "id").alias("doc_id"),
        F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.col("id") * 40), lambda i: F.concat(F.lit("w"), i))).alias("text"),
        F.struct(
            F.lit("p").alias("file_path"), F.lit("d").alias("file_directory"), F.lit("f").alias("filename"),
            F.lit(1).alias("page_number"),
        ).alias("metadata"),
    )
    return embed_hash(chunk_hierarchical(docs), dim=8)


def test_lifecycle(spark, nodes, tmp_path):
    index = Collection(spark, str(tmp_path), "c")
    n = nodes.count()
    assert not index.exists() and index.read().count() == 0
    index.delete_all()
    assert not index.exists()
    index.add(nodes)
    assert index.count() == n
    index.add(nodes)
    assert index.count() == 2 * n
    index.add(nodes, dedupe=True)
    assert index.count() == 2 * n
    index.rebuild(nodes)
    assert index.count() == n
    assert tuple(reconcile(nodes, index.read()).first()) == (n, n, False)
    assert tuple(index.reconciled().first()) == (n, n, False)
    index.delete_all()
    assert index.exists() and index.count() == 0
    assert tuple(reconcile(nodes, index.read()).first()) == (n, 0, True)
    index.add(nodes, dedupe=True)
    assert index.count() == n
    assert index.read().columns == ["node_id", "doc_id", "chunk_idx", "tok_start", "tok_end", "text", "parent_id",
                                    "prev_id", "next_id", "metadata", "embedding", "level"]


def files(index, *trees):
    from pathlib import Path

    return [p for tree in trees or ("nodes", "loose") for p in Path(index.folder, tree).rglob("*.parquet")]


def test_unfinished_writes_are_not_seen(spark, nodes, tmp_path):
    index = Collection(spark, str(tmp_path), "c")
    index.rebuild(nodes)
    n = index.count()

    @F.udf("string")
    def fails(text):
        raise RuntimeError("lost")

    broken = nodes.withColumn("text", fails("text"))
    for write in (index.rebuild, index.add):
        with pytest.raises(Exception, match="lost"):
            write(broken)
        assert index.count() == index.read().count() == n
    (tmp_path / "c" / "manifests" / "x.draft").write_text("{")
    assert index.versions() == [1] and index.read().count() == n
    index.rebuild(nodes)
    assert index.count() == index.read().count() == n
    assert not (tmp_path / "c" / "manifests" / "x.draft").exists()


def test_a_reader_keeps_its_version(spark, nodes, tmp_path):
    index = Collection(spark, str(tmp_path), "c")
    index.rebuild(nodes.where("level = 0"))
    before, n = index.read(), index.count()
    index.rebuild(nodes)
    assert before.count() == n < index.read().count()


def test_level_filter_prunes_partitions(spark, nodes, tmp_path):
    index = Collection(spark, str(tmp_path), "c")
    index.rebuild(nodes)
    leaves = index.read().where("level = 2").select("node_id")
    plan = leaves._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "embedding" not in plan.split("ReadSchema")[1]


def test_cell_filter_prunes_partitions_and_few_probes_few_cells(spark, nodes, tmp_path):
    index = Collection(spark, str(tmp_path), "c")
    index.rebuild(nodes, cells=6)
    model = index.cells()
    asked = nodes.where("level = 2").limit(1).select(F.col("node_id").alias("query_id"), "embedding")
    cell = cells.probed(asked, model, 1).first()["cell"]
    found = index.placed().where(F.col("cell") == cell)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan
    hits = index.lookup(asked, probes=6, rerank=10_000).collect()
    exact = knn.knn_blocks(asked, nodes).collect()
    assert sorted(map(str, hits)) == sorted(map(str, exact))
    index.add(nodes)
    assert index.placed().select("node_id", "cell", "code").distinct().count() == nodes.count()
    again = index.lookup(asked, probes=6, rerank=10_000).collect()
    assert sorted(map(str, again)) == sorted(map(str, exact))


def test_files_follow_the_bytes(spark, nodes, tmp_path):
    index = Collection(spark, str(tmp_path), "c")
    index.rebuild(nodes.repartition(40), cells=5)
    assert len(files(index)) <= 3 * 5
    assert len(files(index, "ids", "sketch")) <= 4
    for i in range(3):
        index.add(nodes.repartition(40), batch=str(i))
    assert len(files(index, "loose")) <= 3 * 3
    index.compact()
    assert len(index.manifest()["segments"]) == 1
    index.vacuum(keep=1)
    assert len(files(index)) <= 3 * 5 and not files(index, "loose")
    assert index.read().count() == index.count() == 4 * nodes.count()


def test_additions_are_merged(spark, nodes, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "SEGMENTS", 3)
    index = Collection(spark, str(tmp_path), "c")
    index.rebuild(nodes.where("level = 2"))
    few = nodes.where("doc_id = 'd3' AND level = 0").cache()
    for i in range(7):
        index.add(few, batch=f"b{i}")
        assert len(index.manifest()["segments"]) <= 4
    index.add(nodes.where("level = 1"), batch="b2")  # replaces a batch that is merged already
    n = {r["level"]: r["count"] for r in nodes.groupBy("level").count().collect()}
    stored = {r["level"]: r["count"] for r in index.read().groupBy("level").count().collect()}
    assert stored == {0: 6 * few.count(), 1: n[1], 2: n[2]} and index.count() == sum(stored.values())
    assert tuple(index.reconciled().first())[2] is False
    index.compact(share=2.0)
    assert len(index.manifest()["segments"]) == 1
    assert {r["level"]: r["count"] for r in index.read().groupBy("level").count().collect()} == stored


def test_old_versions_go(spark, nodes, tmp_path):
    index = Collection(spark, str(tmp_path), "c")
    for _ in range(4):
        index.rebuild(nodes)
    assert index.versions() == [3, 4]
    for tree in ("nodes", "ids", "sketch", "cells"):
        assert len([p for p in (tmp_path / "c" / tree).iterdir() if p.is_dir()]) == 2
    index.delete_all()
    index.vacuum(keep=1)
    assert index.versions() == [5] and not list((tmp_path / "c" / "nodes").iterdir())
    assert index.exists() and index.count() == 0


def test_a_batch_replaces_itself(spark, nodes, tmp_path):
    index = Collection(spark, str(tmp_path), "c")
    half = nodes.where("doc_id < 'd15'")
    index.rebuild(half)
    first = index.count()
    rest = nodes.where("doc_id >= 'd15'")
    for _ in range(2):
        index.add(rest, batch="s-1")
        assert index.count() == nodes.count() > first
    docs = nodes.select("doc_id").distinct()
    fresh = index.unknown_documents(docs, "s-1")
    assert {r.doc_id for r in fresh.collect()} == {r.doc_id for r in rest.select("doc_id").distinct().collect()}
    assert index.unknown_documents(docs, "s-2").count() == 0


def buckets(known):
    """The buckets that the scan of the ids is pruned to."""
    plan = known._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*bucket[^\]]*)\]", plan)
    assert filters or "ids" not in plan
    return {n for f in filters for part in re.findall(r"bucket#\d+L (?:IN \(([\d,]+)\)|= (\d+))", f) for n in ",".join(part).split(",") if n}


def test_known_ids_are_read_only_where_they_may_be(spark, nodes, tmp_path, monkeypatch):
    """No id file is read for new ids, and only the buckets of known ones."""
    monkeypatch.setattr(I, "BUCKET_IDS", 8)
    index = Collection(spark, str(tmp_path), "c")
    index.rebuild(nodes)
    assert len(list((tmp_path / "c" / "ids").rglob("bucket=*"))) > 8
    new = spark.range(500).select(F.concat(F.lit("new"), "id").alias("id"))
    asked = buckets(index.known(new, "node"))
    assert index.known(new, "node").count() == 0
    one = nodes.where("level = 2").limit(1).select(F.col("node_id").alias("id"))
    found = index.known(one, "node")
    assert [r.id for r in found.collect()] == [one.first()["id"]]
    assert len(buckets(found)) == 1
    # False positives of the sketch are few: of 500 new ids hardly any bucket is looked into.
    assert len(asked) <= 6


def test_dedupe_with_repeated_and_null_ids(spark, nodes, tmp_path):
    index = Collection(spark, str(tmp_path), "c")
    index.rebuild(nodes.where("level < 2"))
    many = nodes.unionByName(nodes).repartition(5)
    index.add(many, dedupe=True)
    assert index.count() == nodes.count()
    assert index.read().select("node_id").distinct().count() == nodes.count()
    index.add(nodes, dedupe=True)
    assert index.count() == nodes.count()


def test_only_one_writer_commits_a_version(spark, nodes, tmp_path, monkeypatch):
    index = Collection(spark, str(tmp_path), "c")
    index.rebuild(nodes.where("level = 0"))
    monkeypatch.setattr(index, "versions", lambda: [])
    with pytest.raises(RuntimeError, match="another writer"):
        index._commit([], None)


def test_fetch_reads_only_where_the_ids_are(spark, nodes, tmp_path):
    index = Collection(spark, str(tmp_path), "c")
    doc = F.substring("doc_id", 2, 9).cast("int")
    index.rebuild(nodes.where(doc < 14), cells=6)
    index.add(nodes.where(doc.between(14, 16)))
    index.add(nodes.where(doc > 16))
    columns = ["node_id", "level", "text", "prev_id", "metadata"]
    stored = {r.node_id: r for r in index.read().select(*columns).collect()}
    some = sorted(stored)[::97] + sorted(stored)[:1]
    ids = spark.createDataFrame([(i,) for i in [*some, "nowhere", None]], "id string")
    found = index.fetch(ids)
    assert sorted(found.select(*columns).collect()) == sorted(stored[i] for i in set(some))
    assert found.columns == index.read().columns
    every = index.fetch(index.read().select(F.col("node_id").alias("id")))
    assert every.count() == len(stored)
    # With every other folder spoilt, the one that holds the node is enough.
    home = index.placed().where("level = 2 AND doc_id = 'd5'").first()
    kept = f"level={home.level}/cell={home.cell}/"
    others = [f for tree in ("nodes", "loose") for f in (tmp_path / "c" / tree).rglob("*.parquet") if kept not in str(f)]
    assert len(others) > 6
    for file in others:
        file.write_bytes(b"spoilt")
    one = index.fetch(spark.createDataFrame([(home.node_id,)], "id string")).collect()
    assert [r.text for r in one] == [home.text]


def test_fetch_leaves_out_replaced_batches(spark, nodes, tmp_path):
    index = Collection(spark, str(tmp_path), "c")
    assert index.fetch(spark.createDataFrame([("x",)], "id string")).count() == 0
    index.rebuild(nodes.where("doc_id = 'd1'"))
    for text in ("old", "new"):
        index.add(nodes.where("doc_id = 'd2'").withColumn("text", F.lit(text)), batch="b")
    index.add(nodes.where("doc_id = 'd1'"))
    ids = nodes.where("doc_id IN ('d1', 'd2')").select(F.col("node_id").alias("id"))
    got = index.fetch(ids).groupBy("node_id", "doc_id").agg(F.count("*").alias("n"), F.max("text").alias("text")).collect()
    assert len(got) == ids.distinct().count()
    assert {(r.doc_id, r.n) for r in got} == {("d1", 2), ("d2", 1)}
    assert {r.text for r in got if r.doc_id == "d2"} == {"new"}


def test_fetch_of_nodes_without_a_vector(spark, nodes, tmp_path):
    index = Collection(spark, str(tmp_path), "c")
    bare = nodes.where("doc_id = 'd3'").withColumn("embedding", F.lit(None).cast("array<float>"))
    index.rebuild(nodes.where("doc_id <> 'd3'").unionByName(bare))
    ids = bare.select(F.col("node_id").alias("id"))
    assert index.fetch(ids).count() == ids.count()
