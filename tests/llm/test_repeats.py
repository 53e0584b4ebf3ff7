"""Merged positional transforms against counting every window."""

import collections
import hashlib
import random

import numpy as np
import pytest
from helpers import sentence

from docloom.llm import bwt


def brute(rows, width):
    docs = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = collections.Counter(b[k : k + width] for _, b in docs for k in range(len(b) - width + 1))
    out = []
    for i, b in docs:
        mark = np.zeros(len(b) + 1, int)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                mark[k : k + width] = 1
        kept = bytes(x for x, m in zip(b, mark) if not m)
        spans = int((np.diff(np.concatenate([[0], mark])) == 1).sum())
        out.append((i, len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def check(make_docs, rows, width=400, **more):
    got = [tuple(r) for r in bwt.remove_repeats(make_docs(rows), width, **more).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, width), key=key)
    return got


def texts(seed):
    rng = random.Random(seed)
    passage, other = sentence(rng, 90), sentence(rng, 70)
    rows = []
    for i in range(40):
        parts = [sentence(rng, rng.randrange(5, 120))]
        if i % 3 == 0:
            parts.insert(rng.randrange(2), passage)
        if i % 5 == 0:
            cut = rng.randrange(len(other) // 3)
            parts.append(other[cut:])
        if i % 11 == 0:
            parts = parts * 2
        rows.append((i, rng.choice(["\n", " "]).join(parts), "en", "a"))
    rows += [(100 + i, rows[1][1], "en", "a") for i in range(4)]
    rows += [(200, passage[:400], "en", "a"), (201, "ß" * 400, "de", "a"), (202, "ab" * 500, "de", "b")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(make_docs, seed):
    assert any(r[2] for r in check(make_docs, texts(seed)))


def test_hot_keys_give_the_same(make_docs):
    rows = texts(3)
    got = [tuple(r) for r in bwt.remove_repeats(make_docs(rows), 400, hot=3).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 400), key=key)


def test_small_slices_and_shards(monkeypatch):
    rng = random.Random(5)
    passage = sentence(rng, 40)
    strings = [f"{sentence(rng, 9)}{passage}{sentence(rng, 9)}".encode() for _ in range(6)]
    raw = np.frombuffer(b"".join(strings), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    before = np.array([s.index(passage.encode()) for s in strings])
    want = collections.Counter(s[k : k + 100] for s in strings for k in range(len(s) - 99))
    for size in (1, 500, 1 << 20):
        row, start = bwt.repeated_starts(raw, bounds, np.zeros(6, np.int64), before, 100, size)
        got = sorted(zip(row.tolist(), start.tolist()))
        assert got == sorted((i, k) for i, s in enumerate(strings) for k in range(len(s) - 99) if want[s[k : k + 100]] > 1)
    monkeypatch.setattr(bwt, "SLICE", 700)
    runs = bwt.anchored_runs(raw, bounds, 100, gram=16)
    covered = collections.Counter((t, a + i) for t, a, n in zip(*map(np.ndarray.tolist, runs[:3])) for i in range(n))
    assert covered == collections.Counter((t, k) for t, s in enumerate(strings) for k in range(len(s) - 99))


def test_odd_rows(make_docs, odd_rows, odd):
    got = check(make_docs, odd_rows)
    assert len(got) == len(odd_rows)
    cleaned = bwt.cleaned_documents(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == len(odd_rows)
    assert cleaned.where("text IS NULL").count() == 2


def test_cleaned_text(make_docs):
    rng = random.Random(9)
    passage = "ä" + sentence(rng, 80)
    rows = [(i, sentence(rng, 20) + "\n" + passage + "\n" + sentence(rng, 20), "en", "a") for i in range(2)]
    out = {r.doc_id: r for r in bwt.cleaned_documents(make_docs(rows)).collect()}
    for i, text, *_ in rows:
        assert passage not in out[i].text and out[i].n_chars == len(out[i].text) < len(text)
        assert out[i].text.startswith(text.split("\n")[0]) and out[i].text.endswith(text.split("\n")[2])


def test_empty(empty):
    assert bwt.remove_repeats(empty).count() == 0 and bwt.cleaned_documents(empty).columns == empty.columns
