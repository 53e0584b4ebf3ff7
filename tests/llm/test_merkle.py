"""The Merkle manifest against a recursive construction."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from docloom.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def fold(value, levels, at, seen):
    for level in levels[:-1]:
        run, slot = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
        seen += run[:slot] + run[slot + 1 :]
        value = digest("".join([*run[:slot], value, *run[slot + 1 :]]))
        at //= 16
    return value


def built(rows):
    """All output rows of (doc_id, text, lang, source) rows, as the fixture makes them."""
    def leaf(i, t, lang, s, text):
        fields = (i, s, lang, None if t is None else len(t), text)
        return digest("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    groups = defaultdict(list)
    for i, t, lang, s in rows:
        later = t
        if t is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0:
            later = t.translate(LOWER)
        groups[s].append((i is not None, i or 0, leaf(i, t, lang, s, t), leaf(i, t, lang, s, later), i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for at, (_, _, own, later, i) in enumerate(sorted(groups[s])):
            seen = []
            root = fold(fold(later, trees[s], at, seen), top, j, seen)
            out.append((i, own, trees[s][-1][0], top[-1][0], digest("".join(seen)), root, root == top[-1][0]))
    return out


def same(found, rows):
    assert found.columns == COLUMNS
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(built(rows), key=key)


@pytest.mark.parametrize("sizes", [(1,), (16,), (17,), (1, 15, 16, 17, 33, 255, 256, 257, 300), (1,) * 40])
def test_equals_recursion(make_docs, sizes):
    rows = [(1000 * k + 7 * i, f"Text {i} Of Ünder {k}", "en", f"s{k}") for k, n in enumerate(sizes) for i in range(n)]
    same(merkle.manifest(make_docs(rows)), rows)


def test_hot_source_spreads(make_docs, spark):
    rows = [(i, f"Row {i}", "en", "hot" if i % 3 else f"host{i}") for i in range(1500)]
    same(merkle.manifest(make_docs(rows).repartition(9)), rows)


def test_tampered_rows_fail(make_docs):
    rows = [(i, f"Row {i}" if i % 2 else f"row {i}", "en", "a") for i in range(200)]
    found = {r.doc_id: r.verified for r in merkle.manifest(make_docs(rows)).collect()}
    assert found == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200)}


def test_changed_rows_of_any_kind(make_docs):
    """Another text instead of the lower-cased one, in the rows that are looked at."""
    from pyspark.sql import functions as F

    rows = [(i, f"row {i}", "en", "a") for i in range(50)]
    found = {r.doc_id: r.verified for r in merkle.manifest(make_docs(rows), F.lit("other")).collect()}
    assert found == {i: zlib.crc32(str(i).encode()) % 5 != 0 for i in range(50)}


def test_odd_rows(odd, odd_rows):
    same(merkle.manifest(odd), odd_rows)


def test_names_with_and_without_null(make_docs):
    rows = [(1, "a", None, None), (2, "b", "", ""), (3, None, "de", "é"), (4, "", "de", "z"), (-5, "x", "de", "Z"), (None, "x", "de", "")]
    same(merkle.manifest(make_docs(rows)), rows)


def test_empty_table(empty):
    found = merkle.manifest(empty)
    assert found.columns == COLUMNS and found.count() == 0
