"""The stages against brute-force versions, and the registered queries."""

import collections
import inspect
import random

import numpy as np
import pytest
from helpers import sentence

import __spark_entry__ as entry
import corpus_pipeline
from docloom.llm import oracles, queries


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near duplicates", "repeated passages", "source mix", "packed sequences"
    ]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(oracles.ORACLES) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(20)
    passage = sentence(rng, 90)
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(30, 200)), "please accept the cookies", sentence(rng, 20)]
        if i % 6 == 0:
            parts.insert(1, passage)
        rows.append((i, "\n".join(parts), "en", "abc"[i % 3]))
    rows += [(100 + i, rows[i][1] + " tail", "en", "a") for i in range(5)]
    rows += [(200, "too short", "en", "a"), (201, "spam " * 400, "en", "b")]
    return rows


def test_whole_pipeline(spark, make_docs, corpus, tmp_path):
    make_docs(corpus).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        seen[name] = docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        if name != "packed sequences":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    text = {i: t for i, t, *_ in corpus}

    kept = {r.doc_id: r.text for r in seen["quality rules"].collect()}
    assert set(kept) == set(text) - {200, 201}
    assert all(kept[i] == text[i].replace("please accept the cookies\n", "") for i in range(60))

    shingles = {}
    for i, t in kept.items():
        w = t.lower().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    stay = {r.doc_id for r in seen["near duplicates"].collect()}
    for i in kept:
        twins = [j for j in kept if j < i and 100 * len(shingles[i] & shingles[j]) >= 85 * len(shingles[i] | shingles[j])]
        assert (i in stay) == (not twins)

    before = {r.doc_id: r.text.encode() for r in seen["near duplicates"].collect()}
    windows = collections.Counter(b[k : k + 400] for b in before.values() for k in range(len(b) - 399))
    cleaned = {r.doc_id: r.text for r in seen["repeated passages"].collect()}
    assert set(cleaned) == set(before)
    for i, b in before.items():
        mark = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if windows[b[k : k + 400]] > 1:
                mark[k : k + 400] = True
        assert cleaned[i].encode() == bytes(x for x, m in zip(b, mark) if not m)
    assert any(len(cleaned[i].encode()) < len(b) for i, b in before.items())

    mixed = collections.Counter(r.doc_id for r in seen["source mix"].collect())
    assert set(mixed) <= set(cleaned) and max(mixed.values()) <= 2
    words = {i: len(t.split()) for i, t in cleaned.items()}
    assert abs(sum(words[i] * n for i, n in mixed.items()) - 1.5 * sum(words.values())) < 0.05 * sum(words.values())

    pieces = seen["packed sequences"].collect()
    assert collections.Counter(r.doc_id for r in pieces if r.piece == 0) == mixed
    load = collections.Counter()
    for r in pieces:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= 2048

    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    wanted = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[c] for c in wanted) for r in again) == sorted(tuple(r[c] for c in wanted) for r in pieces)


def test_near_duplicates_from_a_similarity_of_80_percent(spark, make_docs):
    rng = random.Random(21)
    rows = []
    for i in range(20):
        w = [f"w{rng.randrange(1 << 40)}" for _ in range(104)]  # 100 shingles; an edit changes five
        for k in range(4):
            rows.append((10 * i + k, " ".join(w), "en", "a"))
            w = [f"edit{i}-{k}" if j in {0: (20, 60), 1: (30, 40, 50, 70, 80, 90), 2: (25, 35, 45)}.get(k, ()) else x for j, x in enumerate(w)]
    stay = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near duplicates"](spark, make_docs(rows), "").collect()}
    # 90 / 110 is near; 70 / 130 and 85 / 115 or less are not.
    assert stay == {i for i, *_ in rows if i % 10 != 1}
