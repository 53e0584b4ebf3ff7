"""Line rule, near-duplicates, shards, languages, packing, mixing, licences and scores."""

import collections
import random
import zlib

import duckdb
import numpy as np
import pytest
from helpers import sentence

from docloom.llm import kdtree, langid, licenses, lines, lmscore, minhash, mixing, oracles, packing
from docloom.llm.text import shingle_set, word_hashes


def key(row):
    return tuple((x is not None, x) for x in row)


def by_sql(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def same(df, rows, sql):
    names, wanted = by_sql(rows, sql)
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(got, key=key) == sorted(wanted, key=key)
    return got


# --- op 3 ---


def boilerplate_rows():
    rng = random.Random(4)
    rows = [(i, "\n".join([sentence(rng, 12), "Accept  all\tCOOKIES", sentence(rng, 12)]), "en", "a" if i % 3 else None) for i in range(60)]
    rows += [(100 + i, "accept all cookies\n" * 8 + "end of text here", "en", "a") for i in range(3)]
    copied = "\n".join(sentence(rng, 12) for _ in range(5))
    rows += [(200 + i, copied, "en", "a") for i in range(40)]
    rows += [(300 + i, "\n".join(sentence(rng, 12) for _ in range(4)), "en", "a") for i in range(40)]
    rows += [(400, "a b c d e f g h i j\n" * 3, "en", "b"), (401, "w " * 500, "en", "b")]
    return rows


def test_line_rule_equals_sql(make_docs):
    rows = boilerplate_rows()
    got = {r[0]: r for r in same(lines.line_quality(make_docs(rows)), rows, oracles.OP3)}
    names, _ = by_sql(rows, oracles.OP3)
    kept, cut = names.index("kept"), names.index("n_removed_lines")
    assert got[1][cut] == 1 and got[1][kept]
    assert got[100][cut] == 8 and not got[100][kept]
    # Copies of one document do not make its lines boilerplate.
    assert all(got[200 + i][kept] and got[300 + i][kept] and not got[200 + i][cut] for i in range(40))


@pytest.mark.parametrize("shared, own", [(6, 1), (3, 3), (1, 9)])
def test_different_documents_lose_what_they_share(make_docs, shared, own):
    rng = random.Random(shared)
    common = [sentence(rng, 8) for _ in range(shared)]
    rows = []
    for i in range(120):
        lines_ = common + [sentence(rng, 8) for _ in range(own)]
        rng.shuffle(lines_)
        rows.append((i, "\n".join(lines_), "en", "a"))
    # The same lines stay where few documents of a host have them.
    rows += [(500 + i, "\n".join(common + [sentence(rng, 60)]), "en", "b") for i in range(15)]
    got = same(lines.line_quality(make_docs(rows)), rows, oracles.OP3)
    names, _ = by_sql(rows, oracles.OP3)
    cut, kept, i = names.index("n_removed_lines"), names.index("kept"), names.index("doc_id")
    assert all(r[cut] == (shared if r[i] < 500 else 0) for r in got)
    assert all(r[kept] == (r[i] >= 500 or shared <= own) for r in got)


def test_line_rule_on_odd_rows(odd, odd_rows, empty):
    same(lines.line_quality(odd), odd_rows, oracles.OP3)
    assert lines.line_quality(empty).count() == 0


def test_kept_documents_lose_only_boilerplate(make_docs, odd):
    rows = boilerplate_rows()
    docs = make_docs(rows)
    got = {r.doc_id: r for r in lines.keep_documents(docs).collect()}
    verdict = {r.doc_id: r.kept for r in lines.line_quality(docs).collect()}
    assert set(got) == {i for i, k in verdict.items() if k}
    first = rows[1][1].split("\n")
    assert got[1].text == "\n".join([first[0], first[2]]) and got[1].n_chars == len(got[1].text)
    assert got[200].text == rows[63][1]
    strange = lines.keep_documents(odd)
    assert strange.columns == odd.columns and {r._row for r in strange.collect()} == {"x"}


# --- op 4 ---


def near_rows():
    rng = random.Random(6)
    rows, base = [], sentence(rng, 150).split()
    for i in range(120):  # a chain: later copies are far from the first ones
        base[rng.randrange(len(base))] = f"edit{i}"
        rows.append((i, " ".join(base), "en", "a"))
    rows += [(200 + i, sentence(rng, 30), "en", "a") for i in range(30)]
    rows += [(300, rows[125][1].upper(), "en", "a"), (301, "  " + rows[130][1].replace(" ", "\n"), "en", "a")]
    return rows


@pytest.mark.parametrize("cell", [8, 1024])
def test_components_equal_sql(make_docs, monkeypatch, cell):
    monkeypatch.setattr(minhash, "CELL", cell)
    rows = near_rows()
    got = same(minhash.near_duplicates(make_docs(rows)), rows, oracles.OP4)
    sizes = collections.Counter(r[2] for r in got)
    assert max(sizes.values()) > 10


def test_components_of_odd_rows(odd, odd_rows, empty):
    got = [tuple(r) for r in minhash.near_duplicates(odd).collect()]
    named = [r for r in odd_rows if r[0] is not None]
    unique = list(dict.fromkeys(named))
    _, wanted = by_sql(unique, oracles.OP4)
    assert {r for r in got if r[0] is not None} == set(wanted)
    assert [r[2:] for r in got if r[0] is None] == [(None, True)] * 2 and len(got) == len(odd_rows)
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.one_of_each(odd).columns == odd.columns


def test_min_max_estimates_without_bias():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 1200).astype(np.uint64)
    one, two = pool[:1000], pool[200:]
    a, b = minhash.min_max(one, 2000), minhash.min_max(two, 2000)
    assert abs((a == b).mean() - 800 / 1200) < 0.03


def test_word_hashes_follow_words():
    texts = ["Ab  cd\tEF", "", "ab cd ef gh ij kl", "ef", " \n", "ß漢 x" * 3]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    hashes, at = word_hashes(raw, bounds)
    words = [w for t in texts for w in t.encode().lower().split()]
    assert np.diff(at).tolist() == [len(t.encode().split()) for t in texts]
    value = dict(zip(words, hashes.tolist()))
    assert len(set(value.values())) == len(value) and [value[w] for w in words] == hashes.tolist()
    assert len(shingle_set(hashes[:3], 5)) == 1 and len(shingle_set(hashes[:0], 5)) == 0


# --- op 5 ---


def test_shards(make_docs):
    rng = random.Random(7)
    hot = sentence(rng, 100)
    rows = [(i, hot if i % 3 == 0 else sentence(rng, rng.randrange(1, 300)), rng.choice(["en", "de"]), "src" if i % 2 else f"s{i % 9}") for i in range(3000)]
    got = kdtree.kd_shards(make_docs(rows), shards=7).collect()
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    text = {i: t for i, t, *_ in rows}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    slots, size = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert set(slots) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) < 0.03 * sum(size.values()) / 7
    again = {(r.doc_id, r.shard) for r in kdtree.kd_shards(make_docs(rows).repartition(5), shards=7).collect()}
    assert again == {(r.doc_id, r.shard) for r in got}


def test_shards_by_target_and_odd_rows(odd, odd_rows, empty):
    got = kdtree.kd_shards(odd, target_bytes=50_000).collect()
    total = sum(r.size for r in got)
    assert len(got) == len(odd_rows) and {r.shard for r in got} <= set(range(-(-total // 50_000)))
    assert sorted(r.size for r in got if r.doc_id in (3, 4)) == [8, 8]
    assert kdtree.kd_shards(empty, shards=24).count() == 0


@pytest.mark.parametrize("ids", [
    lambda i, rng: (1 << 33) + 7 * i, lambda i, rng: -i - 1, lambda i, rng: rng.randrange(-(1 << 63), 1 << 63), lambda i, rng: (-1) ** i * ((1 << 63) - 1 - i),
])
def test_shards_of_wide_and_negative_ids(make_docs, ids):
    rng = random.Random(9)
    rows = [(ids(i, rng), "ten letters each time", "en", "a") for i in range(2000)]
    size = collections.Counter()
    for r in kdtree.kd_shards(make_docs(rows), shards=8).collect():
        size[r.shard] += r.size
    assert set(size) == set(range(8))
    assert max(size.values()) - min(size.values()) < 0.03 * sum(size.values()) / 8


# --- op 6 ---


def test_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got.doc_id, got.held_out))


def test_language_of_odd_rows(odd, odd_rows, empty, make_docs):
    got = [tuple(r) for r in langid.identify(odd).collect()]
    found = {r[0]: r for r in got}
    assert len(got) == len(odd_rows)
    assert all(found[i][2:4] == ("und", 0.0) for i in (3, 4, 5)) and found[8][2] in ("de", "en")
    assert langid.identify(empty).count() == 0
    unlabelled = langid.identify(make_docs([(1, "some text", None, "a")])).first()
    assert (unlabelled.lang_pred, unlabelled.score) == ("und", 0.0)


# --- op 7 ---


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def fewest(histogram, limit):
    """A lower bound on the sequences that pieces of these lengths need."""
    length = np.arange(limit + 1)
    best = -(-int((histogram * length).sum()) // limit)
    for small in range(1, limit // 2 + 1):
        alone, half = length > limit - small, (length > limit // 2) & (length <= limit - small)
        rest = (length >= small) & (length <= limit // 2)
        free = (histogram * (limit - length))[half].sum()
        over = (histogram * length)[rest].sum() - free
        best = max(best, int(histogram[alone | half].sum() + max(0, -(-over // limit))))
    return best


def packed(df, rows, tokenizer, limit):
    got = df.collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows}
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.length == limit or r.piece == 0
    pieces = collections.Counter()
    for r in got:
        pieces[r.doc_id] += r.length
    copies = collections.Counter(r[0] for r in rows)
    assert pieces == {i: len(x) * copies[i] for i, x in ids.items()}
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= limit
    return len(places), fewest(np.bincount([r.length for r in got], minlength=limit + 1), limit)


def test_packing(make_docs, tokenizer):
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.choice([1, 3, 10, 40, 90, 300])), "en", "a") for i in range(800)]
    rows += [(1000 + i, "same text here", "en", "a") for i in range(400)]
    sequences, least = packed(packing.pack(make_docs(rows), limit=128), rows, tokenizer, 128)
    assert sequences <= 1.03 * least + 1


def test_packing_of_odd_rows(make_docs, odd, odd_rows, empty, tokenizer):
    named = [r for r in odd_rows if r[0] is not None and r[0] != 1 or r is odd_rows[0]]
    packed(packing.pack(make_docs(named)), named, tokenizer, 2048)
    got = packing.pack(odd).collect()
    assert collections.Counter(r.doc_id for r in got)[1] == 2
    assert [(r.start, r.length) for r in got if r.doc_id == 3] == [(0, 1)]
    assert packing.pack(empty).count() == 0


def test_plan_covers_every_length():
    rng = np.random.default_rng(3)
    for scale in (1, 40, 5000):
        histogram = np.zeros(257, np.int64)
        for length in rng.integers(1, 257, 300):
            histogram[length] += rng.integers(1, scale + 1)
        plan = packing.packing_plan(histogram, 256)
        ranks = collections.defaultdict(list)
        used = 0
        for length, first, count, sequence, offset in plan:
            ranks[length].append((first, count))
            used = max(used, sequence + count)
            assert offset + length <= 256
        for length, spans in ranks.items():
            at = 0
            for first, count in sorted(spans):
                assert first == at
                at += count
            assert at == histogram[length]
        assert set(ranks) == set(np.flatnonzero(histogram).tolist())
        assert used <= 1.04 * fewest(histogram, 256) + 2


def test_fit_reproduces_a_mixture_of_patterns():
    present = np.ones(65, bool)
    table = packing.patterns(present, 64, step=8)
    truth = np.zeros(len(table))
    truth[[3, 17, 40]] = [500, 200, 300]
    histogram = sum(np.bincount(table[:, j], truth, 65) for j in range(3))
    x = packing.non_negative_fit(table, histogram, 3000)
    again = sum(np.bincount(table[:, j], x, 65) for j in range(3))
    assert x.min() >= 0 and np.abs(again - histogram)[1:].max() < 5


# --- op 8 ---


def water_level(sizes, weights=(5, 2, 1)):
    """Targets by lowering every excess in turn."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, rest = {}, 1.5 * sum(sizes.values()), set(names)
    while rest:
        total = sum(weight[s] for s in rest)
        full = {s for s in rest if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            return {**target, **{s: left * weight[s] / total for s in rest}}
        target.update({s: 2.0 * sizes[s] for s in full})
        left -= sum(2 * sizes[s] for s in full)
        rest -= full
    return target


def test_mixture(make_docs):
    rng = random.Random(10)
    rows = [(i, sentence(rng, min(900, int(rng.lognormvariate(4, 1)) + 1)), "en", rng.choice(["a", "b", "c", "é", None, "hot", "hot", "hot"])) for i in range(3000)]
    docs = make_docs(rows)
    got = mixing.mixture(docs, keep=("doc_id", "source"), block=200).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    target = water_level(sizes)
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        assert r.copies in (int(target[r.source] / sizes[r.source]), int(target[r.source] / sizes[r.source]) + 1)
    assert len(got) == len(rows)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in sizes)
    again = mixing.mixture(docs.repartition(7), keep=("doc_id", "source"), block=200).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_pivotal_keeps_words_and_expectation():
    size = np.array([900.0, 500, 450, 120, 90, 60, 30, 20, 10, 5] * 6)
    p = np.full(len(size), 0.3)
    sums = np.zeros(len(size))
    for seed in range(3000):
        out = mixing.pivotal(p, size, np.random.default_rng(seed))
        assert ((out > 0) & (out < 1)).sum() <= 1
        assert abs((out * size).sum() - (p * size).sum()) < 1e-6 * size.sum()
        sums += out
    assert np.abs(sums / 3000 - 0.3).max() < 0.05


def test_mixture_of_odd_rows(odd, odd_rows, empty):
    got = mixing.mixture(odd).collect()
    assert len(got) == len(odd_rows) and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mixture(empty).count() == 0 and mixing.mixed_documents(empty).columns == empty.columns
    blank = mixing.mixture(odd.where("text IS NULL")).collect()
    assert {(r.size, r.target, r.taken) for r in blank} == {(0, 0.0, 0)}
    copies = collections.Counter(r.text for r in mixing.mixed_documents(odd).collect())
    assert copies[odd_rows[7][1]] <= 2


# --- op 9 ---


def test_licenses(make_docs, small, spark, odd, odd_rows, empty):
    plain = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    notices = {
        "mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.",
        "gpl": "This work is licensed under the GNU General Public License, version 2.", "cc-by-nc": "Licensed under CC BY-NC 3.0.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "unknown": "Licensed under the Zorbax Free License.",
    }
    body = next(t for _, t, lang, _ in plain if lang == "en" and "icense" not in t and len(t) > 500).split("\n")
    rows = [r for r in plain if "icense" not in r[1]] + [(10_000 + k, "\n".join([body[0], n, body[-1]]), "en", "a") for k, n in enumerate(notices.values())]
    got = {r.doc_id: r for r in licenses.scan_licenses(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    assert [got[10_000 + k].license for k in range(len(notices))] == list(notices)
    clean = [r for i, r in got.items() if i < 10_000]
    assert sum(r.license != "none" for r in clean) <= 0.01 * len(clean)
    strange = licenses.scan_licenses(odd).collect()
    assert len(strange) == len(odd_rows) and {r.license for r in strange if r.doc_id in (3, 4, 5)} == {"none"}
    assert licenses.scan_licenses(empty).count() == 0


# --- op 10 ---


def test_scores_equal_counting(spark, make_docs):
    rng = random.Random(12)
    good, bad = ("oak", "elm", "fir", "ash"), ("buy", "now", "cheap", "click")
    rows = [(i, sentence(rng, 40, good if i % 2 else bad), "en", "a") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lmscore.score(make_docs(rows), labels).collect()}
    target = {i for i in range(60) if i % 2 and i != 1}

    def steps(text):
        """(word class, class before, pair class) of each word."""
        raw = np.frombuffer(text.encode(), np.uint8)
        word, before, pair, _ = lmscore._classes(raw, np.array([0, len(raw)]))
        assert len(word) == len(text.split()) and before[1:].tolist() == word[:-1].tolist()
        return list(zip(word.tolist(), before.tolist(), pair.tolist()))

    counts = [[collections.Counter() for _ in range(3)] for _ in range(2)]
    for i, t, *_ in rows:
        for side in [0] + [1] * (i in target):
            for step in steps(t):
                for kind, c in enumerate(step):
                    counts[side][kind][c] += 1
    classes = 1 << lmscore.WORD_BITS

    def loss(i, text, side):
        """In models without the document itself."""
        own = [collections.Counter(c) for c in zip(*steps(text))]
        less = lambda k, kind, c: counts[k][kind][c] - (own[kind][c] if k == 0 or i in target else 0)
        total = sum(counts[1][0].values()) - (len(text.split()) if side and i in target else 0)
        scale = 1.0 if side else total / (sum(counts[0][0].values()) - len(text.split()))
        out = 0.0
        for w, b, p in steps(text):
            single = (scale * less(side, 0, w) + 0.5) / (total + 0.5 * classes)
            out -= np.log((scale * less(side, 2, p) + 64 * single) / (scale * less(side, 1, b) + 64))
        return out / len(text.split())

    for i, t, *_ in rows:
        assert abs(got[i].target_loss - loss(i, t, 1)) < 1e-5 and abs(got[i].background_loss - loss(i, t, 0)) < 1e-5
        assert abs(got[i].score - (got[i].target_loss - got[i].background_loss)) < 1e-12
    assert max(got[i].score for i in range(61, 80, 2)) < min(got[i].score for i in range(60, 80, 2))


def test_a_label_alone_changes_no_score(spark, make_docs):
    """A random third of like documents as target: no gap between those with and those without a label."""
    rng = random.Random(21)
    rows = [(i, sentence(rng, 80), "en", "a") for i in range(600)]
    picked = set(rng.sample(range(600), 200))
    labels = spark.createDataFrame([(i, int(i in picked), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in lmscore.score(make_docs(rows), labels).collect()}
    inside, outside = [got[i] for i in picked], [got[i] for i in range(600) if i not in picked]
    spread = np.std(inside + outside)
    assert abs(np.mean(inside) - np.mean(outside)) < 0.25 * spread
    assert min(outside) < np.median(inside) < max(outside)


def test_scores_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    got = lmscore.score(odd, labels).collect()
    assert len(got) == len(odd_rows)
    assert all((r.score is None) == (r.n_tokens == 0) for r in got)
    assert lmscore.score(odd, labels.limit(0)).count() == len(odd_rows)
    assert lmscore.score(empty, labels).count() == 0


def test_scores_do_not_share_counts_between_words(spark, make_docs):
    """Many rare words change nothing for the words that others use, and losses are of probabilities."""
    rng = random.Random(13)
    few = [(i, "oak elm fir ash " * 10, "en", "a") for i in range(20)]
    rare = [(100 + i, " ".join(f"w{rng.randrange(1 << 60)}" for _ in range(20_000)), "en", "a") for i in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lmscore.score(make_docs(few + rare), labels).collect()}
    assert all(r.target_loss >= 0 and r.background_loss >= 0 for r in got.values())
    total, words = 360, 4 + len({w for _, t, *_ in rare for w in t.split()})
    assert words > 1 << lmscore.WORD_BITS

    def loss(pair, word, context):
        return -np.log((pair + 64 * (word + 0.5) / (total + 0.5 * words)) / (context + 64))

    # Ten documents of the target, one of which is the one that is scored.
    wanted = (loss(9, 90, 9) + 9 * loss(81, 90, 81) + 30 * loss(90, 90, 90)) / 40
    assert abs(got[0].target_loss - wanted) < 1e-9
    assert got[0].n_tokens == 40 and got[100].n_tokens == 20_000
