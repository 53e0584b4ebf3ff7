"""Fixed-block anchors against a rule that looks at every window."""

import hashlib
import random
import re

import pytest
from helpers import sentence

from docloom.llm import anchors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(rows, window=20):
    """(doc_id, n_words, n_removed, kept_sha256) of each row; rows of one id count as one document."""
    words = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            place = ((i is not None, i or 0), s)
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, place), place)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < ((i is not None, i or 0), s):
                gone.update(range(s, s + window))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def judged(df, window=20):
    found = anchors.remove_repeats(df, window)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return [tuple(r) for r in found.collect()]


def same(found, expected):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(found, key=key) == sorted(expected, key=key)


def corpus(rng, n):
    """Passages at any offset, near copies and copies of thousands of windows, in shuffled ids."""
    passages = [sentence(rng, k) for k in (19, 20, 21, 25, 40, 90)]
    base = sentence(rng, 300).split()
    rows = []
    for i in range(n):
        words = sentence(rng, rng.randrange(0, 60)).split()
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passages[rng.randrange(len(passages))].split()
        if i % 5 == 0:
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(9999)}"
            if rng.randrange(2):
                words.insert(rng.randrange(len(words)), "extra")
        if i % 11 == 0:
            words += words
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words), "en", f"s{i % 3}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_every_window(make_docs, monkeypatch, small):
    if small:  # many slices, flushes and buckets
        for name, value in (("SLICE", 1 << 10), ("GATHER", 1 << 9), ("BUCKET", 1 << 10)):
            monkeypatch.setattr(anchors, name, value)
    rows = corpus(random.Random(4), 240)
    same(judged(make_docs(rows).repartition(7)), counted(rows))


@pytest.mark.parametrize("window", [1, 2, 7, 20, 33])
def test_other_widths(make_docs, window):
    rows = corpus(random.Random(window), 60)
    same(judged(make_docs(rows), window), counted(rows, window))


def test_a_third_share_one_passage(make_docs):
    rng = random.Random(6)
    shared = sentence(rng, 50)
    rows = [(i, f"{sentence(rng, 12)} {shared if i % 3 == 0 else sentence(rng, 30)} {sentence(rng, 9)}", "en", "a") for i in range(900)]
    found = judged(make_docs(rows).repartition(16))
    same(found, counted(rows))
    assert sum(r[2] >= 50 for r in found) == 299


def test_nineteen_words_stay(make_docs):
    words = [f"w{i}" for i in range(19)]
    rows = [(i, " ".join([f"a{i}", *words, f"b{i}"]), "en", "a") for i in range(5)]
    assert all(r[2] == 0 for r in judged(make_docs(rows)))


def test_overlap_in_one_document(make_docs):
    rows = [(1, " ".join(["x"] * 45), "en", "a"), (2, " ".join(["x"] * 21), "en", "a")]
    same(judged(make_docs(rows)), counted(rows))


def test_odd_rows(odd, odd_rows):
    same(judged(odd), counted(odd_rows))


def test_empty_table(empty):
    assert judged(empty) == []
