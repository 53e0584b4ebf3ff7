import random

import numpy as np

from docloom.llm import lmscore
from docloom.session import with_conf


def _scores(docs, labels):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.target_loss, r.background_loss) for r in lmscore.score(docs, labels).collect()), key=str)


def test_chunks_and_buckets_change_no_score(spark, monkeypatch):
    """Small chunks over several row groups and splits, many buckets: the same as all in one."""
    rng = random.Random(5)
    rows = [(i % 190 or None, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(60))) if i % 17 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 190, 3)], "doc_id long, quality int, toxic int")
    wanted = _scores(docs, labels)
    monkeypatch.setattr(lmscore, "CHUNK", 1 << 11)
    monkeypatch.setattr(lmscore, "BUCKET", 100)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.setInt("parquet.block.size", 2048)
    try:
        with with_conf(spark, {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.shuffle.partitions": "3"}):
            got = _scores(docs, labels)
    finally:
        hadoop.unset("parquet.block.size")
    assert [g[:3] for g in got] == [w[:3] for w in wanted]
    for g, w in zip(got, wanted):
        assert (g[3] is None) == (w[3] is None) == (g[2] == 0)
        assert g[3] is None or np.allclose(g[3:], w[3:], rtol=1e-9)


def test_a_chunk_sends_each_pair_once():
    """Rows that are moved follow the chunks and buckets, not the pairs."""
    import pyarrow as pa

    chunk = lmscore._Chunk(pa.chunked_array([pa.array(["a b a b a b", None, "b a"])]), 4)
    asked = list(chunk.asked(np.array([True, False, False])))
    pairs = np.concatenate([np.frombuffer(r[1], np.uint64) for r in asked])
    counts = np.concatenate([lmscore._longs(r[2], 2) for r in asked], axis=1)
    assert len(asked) <= 4 and len(set(pairs.tolist())) == len(pairs) == 4
    assert counts.sum(axis=1).tolist() == [8, 6]
