"""Rounds of star contractions, and steps of op 4 that have nothing left to do."""

import random

import pytest
from helpers import sentence

from docloom.llm import graph, minhash

SCHEMA = "a long, b long"


@pytest.fixture
def written(monkeypatch):
    """Names of the tables that op 4 writes."""
    names = []

    def noted(df, name, *rest, real=minhash.materialize):
        names.append(name)
        return real(df, name, *rest)

    monkeypatch.setattr(minhash, "materialize", noted)
    monkeypatch.setattr(graph, "materialize", noted)
    return names


def roots_of(edges):
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return {n: r for n, r in root.items() if n != r}


def test_stars_take_no_round(spark, written):
    edges = [(1, i) for i in range(2, 50)] + [(70, 60), (5_000, 60), (9, 9), (None, 3)]
    found = graph.stars(spark.createDataFrame(edges, SCHEMA)).collect()
    assert {r.node: r.root for r in found} == {**{i: 1 for i in range(2, 50)}, 70: 60, 5_000: 60}
    assert len(found) == 50 and written == []
    assert graph.stars(spark.createDataFrame([], SCHEMA)).count() == 0 and written == []


def test_paths_and_random_edges(spark, written):
    rng = random.Random(3)
    path = rng.sample(range(1000, 2000), 64)
    edges = [*zip(path, path[1:]), *((rng.randrange(60), rng.randrange(60)) for _ in range(45))]
    edges += edges[:9] + [(b, a) for a, b in edges[:9]] + [(900, i) for i in range(800, 830)]
    found = graph.stars(spark.createDataFrame(edges, SCHEMA)).collect()
    assert {r.node: r.root for r in found} == roots_of(edges) and len(found) == len(roots_of(edges))
    assert len(written) <= 8


def test_roots_are_extended(spark):
    old = spark.createDataFrame([(2, 1), (3, 1), (8, 7), (20, 10)], "node long, root long")
    more = spark.createDataFrame([(7, 1), (30, 10)], "node long, root long")
    got = sorted(map(tuple, graph.extended(old, more).collect()))
    assert got == [(2, 1), (3, 1), (7, 1), (8, 1), (20, 10), (30, 10)]


def test_buckets_of_one_block_are_compared_once(make_docs, written):
    rng = random.Random(8)
    base, rows = sentence(rng, 150).split(), []
    for i in range(60):
        base[rng.randrange(len(base))] = f"edit{i}"
        rows.append((i, " ".join(base), "en", "a"))
    assert minhash.near_duplicates(make_docs(rows)).select("component_id").distinct().count() < 20
    assert written.count("minmax-links") == 2 and "minmax-outside" not in written
    assert written.count("edges") <= 6
