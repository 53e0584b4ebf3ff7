import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunks as K
from docloom.operators.embed import embed_hash, hash_model, model_column
from docloom.plans.ingest import build_nodes


def windows(n, size, overlap=75):
    stride = size - overlap
    last = 0 if n <= size else math.ceil((n - size) / stride) * stride
    return [(s, min(s + size, n)) for s in range(0, last + 1, stride)]


def expected_nodes(doc, n, sizes):
    levels = [[(s, e, str(i), None) for i, (s, e) in enumerate(windows(n, sizes[0]))]]
    for size in sizes[1:]:
        levels.append(
            [
                (s + a, s + b, f"{path}.{i}", path)
                for s, e, path, _ in levels[-1]
                for i, (a, b) in enumerate(windows(e - s, size))
            ]
        )

    def node_id(level, path):
        return hashlib.sha256(f"{doc}|{level}|{path}".encode()).hexdigest()

    return {
        node_id(level, path): (level, i, s, e, None if parent is None else node_id(level - 1, parent))
        for level, spans in enumerate(levels)
        for i, (s, e, path, parent) in enumerate(spans)
    }


LENGTHS = [0, 1, 75, 76, 255, 256, 257, 511, 512, 513, 1024, 1025, 1973, 1974, 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(n, "  ".join(f"w{rng.randrange(999)}" for _ in range(n)), f"s{n % 3}") for n in LENGTHS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_hierarchy(docs):
    tokens = {r.doc_id: r.text.split() for r in docs.collect()}
    by_doc = {}
    for r in K.chunk_hierarchical(docs).collect():
        by_doc.setdefault(r.doc_id, {})[r.node_id] = r
    for n in LENGTHS:
        expected = expected_nodes(n, n, (1024, 512, 256))
        got = by_doc[n]
        assert {k: (r.level, r.chunk_idx, r.tok_start, r.tok_end, r.parent_id) for k, r in got.items()} == expected
        for r in got.values():
            assert r.text == " ".join(tokens[n][r.tok_start : r.tok_end])
            assert r.source == f"s{n % 3}"
            if r.parent_id:
                parent = got[r.parent_id]
                assert parent.tok_start <= r.tok_start and r.tok_end <= parent.tok_end
        for level in range(3):
            row = sorted((r for r in got.values() if r.level == level), key=lambda r: r.chunk_idx)
            ids = [r.node_id for r in row]
            assert [r.prev_id for r in row] == [None, *ids[:-1]]
            assert [r.next_id for r in row] == [*ids[1:], None]
            covered = set().union(*(range(r.tok_start, r.tok_end) for r in row))
            assert covered == set(range(n))


def test_fixed_windows_overlap(docs):
    for r in K.chunk_fixed(docs, 256).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_idx", "tok_start", "tok_end"))).alias("c")
    ).collect():
        spans = [(c.tok_start, c.tok_end) for c in r.c]
        assert spans == windows(r.doc_id, 256)
        assert all(a[1] - b[0] == 75 for a, b in zip(spans, spans[1:]))
        assert len(spans) == 1 or spans[-1][1] - spans[-1][0] > 75


def test_children_and_dedupe(docs):
    nodes = K.chunk_hierarchical(docs)
    rows = nodes.collect()
    expected = {}
    for r in sorted(rows, key=lambda r: r.chunk_idx):
        if r.parent_id:
            expected.setdefault(r.parent_id, []).append(r.node_id)
    assert {r.node_id: r.children for r in K.children(nodes).collect()} == expected
    kept = K.dedupe_texts(nodes).collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r.level, r.chunk_idx)):
        first.setdefault((r.doc_id, r.text), r.node_id)
    assert {(r.doc_id, r.text): r.node_id for r in kept} == first
    assert {r.level for r in K.leaves(nodes).collect()} == {2}


def test_parser_and_embedding_are_replaceable(spark):
    rows = [("f", "d", "f", 0, None, "eins zwei drei", 1), ("f", "d", "f", 1, None, "", None)]
    df = spark.createDataFrame(
        rows, "file_path string, file_directory string, filename string, elem_idx int, type string, text string, "
        "page_number int"
    )
    small = build_nodes(df, K.hierarchical_parser((2,), 1), lambda d, t: d.withColumn("embedding", F.lit(1)))
    assert sorted(r.text for r in small.collect()) == ["", "eins zwei", "zwei drei"]
    assert {r.metadata.page_number for r in small.collect()} == {1, None}


def test_embeddings_are_unit_vectors_of_token_counts(spark):
    texts = ["a b a", "A  B a", "", "ganz anderer Text", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    model = model_column(hash_model(32), batch=2)
    for got in (embed_hash(df, dim=32), df.withColumn("embedding", model("text"))):
        v = {r.i: r.embedding for r in got.collect()}
        assert v[0] == v[1] and v[0] != v[3]
        assert set(v[2]) == {0.0} and set(v[4]) == {0.0}
        assert all(abs(sum(x * x for x in v[i]) - 1) < 1e-5 for i in (0, 3))
        assert {len(x) for x in v.values()} == {32}


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        import numpy as np

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: np.ones((len(texts), 2))

    df = spark.range(0, 1000, 1, 1).selectExpr("id", "cast(id as string) text")
    column = model_column(load)
    for _ in range(6):
        assert df.withColumn("e", column("text")).where("e[0] = 1").count() == 1000
    workers = [path.name.split("-")[0] for path in tmp_path.iterdir()]
    assert workers and len(workers) == len(set(workers))
