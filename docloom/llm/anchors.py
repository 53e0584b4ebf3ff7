"""Repeated word passages: fixed blocks are indexed, every rolling window probes them, hits are extended.

A window of 20 words holds at least one whole block of 10 words whose start is
a multiple of 10, wherever it begins. So the blocks at those places are the
index, every 10-word window is a probe, and a 20-word window that starts
earlier somewhere else has a hit on a block of that earlier place. A hit is
extended to both sides: the 20-word windows around it are compared with those
around the blocks that were hit, and what overlaps makes up the longest
repeat.

Occurrences travel packed: a task gathers those of some million words, keeps
one of each that it has several of, and deals them by hash into buckets of
bounded size. A passage that a third of the documents share is one occurrence
per task in its bucket.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.text import GOLDEN, MIX_A, MIX_B, WORD, byte_slices, mix, string_buffers, word_hashes
from docloom.session import discard, materialize

# Bytes of text hashed at once, words gathered before they are dealt out, words meant for a bucket.
SLICE = 1 << 20
GATHER = 1 << 19
BUCKET = 1 << 20
# Stands for a null id: before all others.
NO_ID = -(1 << 63)
PACKED = "bucket int, done boolean, docs array<long>, counts array<int>, at binary, more binary, low binary, high binary"
_WORD = re.compile(WORD)


def rolled(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes, from runs of doubled length."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    out, taken, now, size, power = None, 0, hashes, 1, base
    while taken < width:
        if width & size:
            if out is None:
                out, taken = now, size
            else:
                n = len(hashes) - taken - size + 1
                out, taken = out[:n] * np.uint64(power) + now[taken : taken + n], taken + size
        now = now[:-size] * np.uint64(power) + now[size:]
        power, size = power * power % (1 << 64), size * 2
    return mix(out)


class Packer:
    """Occurrences (document, place, hashes) of a task, dealt into buckets."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, doc: np.ndarray, at: np.ndarray, *hashes: np.ndarray) -> None:
        self.held.append((doc, at, *hashes))
        self.size += len(doc)

    def flush(self, choose):
        """Packed rows of all that was added.

        ``choose(doc, at, group)`` sees the occurrences ordered by hash and
        place, with the number of their hash, and says which are sent, which
        have more of their kind, and which are decided here.
        """
        if not self.size:
            return
        columns, self.held, self.size = [np.concatenate(c) for c in zip(*self.held)], [], 0
        order = np.lexsort((columns[1], columns[0], *columns[2:]))
        doc, at, *hashes = (c[order] for c in columns)
        del columns, order
        sent, more, done = choose(doc, at, _groups(hashes))
        for chosen, decided in ((sent, False), (done, True)):
            if chosen.any():
                yield self._packed(doc[chosen], at[chosen], [h[chosen] for h in hashes], more[chosen], decided)

    def _packed(self, doc, at, hashes, more, decided: bool) -> pa.RecordBatch:
        share = mix(doc.view(np.uint64)) if decided else hashes[0]
        bucket = ((share >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((at, doc, bucket))
        doc, at, bucket = doc[order], at[order], bucket[order]
        runs = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])))
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        edge = np.append(first, len(doc))

        def lists(values, kind, ends):
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))

        def cut(values):
            return pa.array([values[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())

        none = pa.nulls(len(first), pa.binary())
        by_run = np.append(np.searchsorted(runs, first), len(runs))
        # The bucket stands for some bits of a single hash; 32 others tell its members apart.
        keys = [h[order].astype(np.uint32) if len(hashes) == 1 else h[order] for h in hashes]
        keys = [none, none] if decided else [*map(cut, keys), none][:2]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[first], pa.int32()),
                pa.array(np.full(len(first), decided)),
                lists(doc[runs], pa.int64(), by_run),
                lists(np.diff(np.append(runs, len(doc))), pa.int32(), by_run),
                cut(at.astype(np.uint32)),
                none if decided else cut(more[order]),
                *keys,
            ],
            names=["bucket", "done", "docs", "counts", "at", "more", "low", "high"],
        )


def _groups(hashes: list[np.ndarray]) -> np.ndarray:
    """Numbers of equal neighbours."""
    fresh = np.zeros(len(hashes[0]), bool)
    fresh[:1] = True
    for h in hashes:
        fresh[1:] |= h[1:] != h[:-1]
    return np.cumsum(fresh) - 1


def _numbers(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(string_buffers(column)[0].tobytes(), kind)


def _places(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    doc = np.repeat(rows.column("docs").flatten().to_numpy(), rows.column("counts").flatten().to_numpy())
    return doc, _numbers(rows.column("at"), np.uint32).astype(np.int64)


def _bucketwise(packed: DataFrame, judge, kinds: list) -> DataFrame:
    """(doc, at) of what was decided in the tasks and of what ``judge`` chooses in each bucket.

    ``judge(doc, at, group, more)`` sees a bucket's occurrences ordered by hash
    and place. ``kinds`` are the types of the hashes.
    """

    def solve(rows: pa.RecordBatch):
        done = rows.column("done")
        yield _places(rows.filter(done))
        rows = rows.filter(pa.compute.invert(done))
        if rows.num_rows:
            doc, at = _places(rows)
            hashes = [_numbers(rows.column(c), kind) for c, kind in zip(("low", "high"), kinds)]
            order = np.lexsort((at, doc, *hashes))
            doc, at, hashes = doc[order], at[order], [h[order] for h in hashes]
            chosen = judge(doc, at, _groups(hashes), _numbers(rows.column("more"), bool)[order])
            yield doc[chosen], at[chosen]

    def out(held):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        for doc, at in (x for r in rows for x in solve(r)):
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at, pa.int32())], names=["doc", "at"])

    def run(batches):
        held, bucket = [], None
        for batch in batches:
            own = batch.column("bucket").to_numpy()
            edge = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else []
            for a, b in zip(edge, [*edge[1:], len(own)]):
                if own[a] != bucket and held:
                    yield from out(held)
                    held = []
                bucket = own[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from out(held)

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "doc long, at int")


def _pieces(batch, width: int):
    """(row numbers, word hashes, each word's row in the piece, each word's place, word offsets) of slices of a batch."""
    raw, bounds = string_buffers(batch.column("text"))
    for first, last in byte_slices(bounds, SLICE):
        a, b = bounds[first], bounds[last]
        hashes, offsets = word_hashes(raw[a:b], bounds[first : last + 1] - a, lower=False)
        row = np.repeat(np.arange(first, last), np.diff(offsets))
        yield row, hashes, np.arange(len(hashes)) - offsets[row - first] if len(hashes) else row


def _first_of_each(doc, at, group):
    """True for the first occurrence of each group; occurrences are ordered."""
    return np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)


def blocks(texts: DataFrame, block: int, buckets: int) -> DataFrame:
    """Packed occurrences of every window of ``block`` words; those at multiples of ``block`` are the index.

    Of equal windows of a task only the first and the first indexed one are
    sent; all others have an occurrence before them and count as hits.
    """

    def choose(doc, at, group):
        first = _first_of_each(doc, at, group)
        index = at % block == 0
        lead = np.zeros(len(doc), bool)
        places = np.flatnonzero(index)
        lead[places[np.append(True, group[places][1:] != group[places][:-1])] if len(places) else places] = True
        sent = first | lead
        many = np.bincount(group, minlength=1)[group] > 1
        return sent, many, ~sent

    def run(batches):
        packer = Packer(buckets)
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for row, hashes, place in _pieces(batch, block):
                key = rolled(hashes, block, int(GOLDEN))
                n = len(key)
                whole = row[:n] == row[block - 1 :] if n else np.zeros(0, bool)
                packer.add(ids[row[:n][whole]], place[:n][whole], key[whole])
                if packer.size >= GATHER:
                    yield from packer.flush(choose)
        yield from packer.flush(choose)

    return texts.select("doc", "text").mapInArrow(run, PACKED)


def hits(packed: DataFrame, block: int) -> DataFrame:
    """(doc, at): the probes behind an indexed block of the same words, and the first such block itself."""

    def judge(doc, at, group, more):
        index = at % block == 0
        n = np.bincount(group) + np.bincount(group, more)
        lead = np.full(len(n), len(doc))
        np.minimum.at(lead, group[index], np.flatnonzero(index))
        return (n[group] > 1) & (np.arange(len(doc)) >= lead[group])

    return _bucketwise(packed, judge, [np.uint32])


def _joined_places(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the sorted places of ``found`` in each document; null where there is none."""
    at = found.groupBy(F.col("doc").alias("_doc")).agg(F.sort_array(F.collect_set("at")).alias("at"))
    return rows.join(at, F.col("doc") == F.col("_doc"), "left")


def _kept(text: str | None, starts, window: int) -> tuple[int, int, str, str]:
    """(words, words removed, what is left, its digest)."""
    words = _WORD.findall(text or "")
    gone = np.zeros(len(words) + 1, np.int64)
    if starts:
        begin = np.array([s for s in starts if s + window <= len(words)], np.int64)
        np.add.at(gone, begin, 1)
        np.add.at(gone, begin + window, -1)
    covered = np.cumsum(gone)[: len(words)] > 0
    left = " ".join(w for w, c in zip(words, covered) if not c) if covered.any() else " ".join(words)
    return len(words), int(covered.sum()), left, hashlib.sha256(left.encode()).hexdigest()


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _results(ids, texts, starts, window: int):
    rows = [_kept(t, s, window) for t, s in zip(texts, starts)]
    n, gone, _, sha = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
    return [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]


def _settled(joined: DataFrame, window: int) -> DataFrame:
    """Documents without a hit with their result; of the others, text and places."""

    def run(batches):
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), batch.column("at")
            live = at.is_valid().to_pylist()
            _, n, gone, sha = _results(None, [None if x else t for t, x in zip(texts, live)], [None] * len(texts), window)
            text = pa.array([t if x else None for t, x in zip(texts, live)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n, gone, sha, batch.column("doc"), text, at],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "doc", "text", "at"],
            )

    return joined.select("doc_id", "doc", "text", "at").mapInArrow(run, f"{RESULT}, doc long, text string, at array<int>")


def extended(live: DataFrame, block: int, window: int, buckets: int) -> DataFrame:
    """Packed occurrences of the ``window``-word windows that hold a hit.

    Equal windows of a task are known to repeat: the first is sent, the
    others are decided where they start behind it.
    """

    def choose(doc, at, group):
        sent = _first_of_each(doc, at, group)
        lead = np.flatnonzero(sent)[group]
        later = ~sent & ((doc != doc[lead]) | (at != at[lead]))
        return sent, np.zeros(len(doc), bool), later

    def run(batches):
        packer = Packer(buckets)
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            lists = batch.column("at")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            for row, hashes, place in _pieces(batch, window):
                if not len(hashes):
                    continue
                low, high = (rolled(hashes, window, int(b)) for b in (MIX_A, MIX_B))
                n = len(low)
                if not n:
                    continue
                begin = np.flatnonzero(place == 0)
                mine = (of >= row[0]) & (of <= row[-1])
                begin_of = np.full(row[-1] + 1, -1)
                begin_of[row[begin]] = begin
                hit = begin_of[of[mine]] + flat[mine]
                near = np.zeros(len(hashes) + 1, np.int64)  # a window's first whole block starts within ``block`` words
                np.add.at(near, np.maximum(hit - block + 1, begin_of[of[mine]]), 1)
                np.add.at(near, hit + 1, -1)
                chosen = (np.cumsum(near)[:n] > 0) & (row[:n] == row[window - 1 :])
                packer.add(ids[row[:n][chosen]], place[:n][chosen], low[chosen], high[chosen])
                if packer.size >= GATHER:
                    yield from packer.flush(choose)
        yield from packer.flush(choose)

    return live.select("doc", "text", "at").mapInArrow(run, PACKED)


def repeats(packed: DataFrame) -> DataFrame:
    """(doc, at): the windows that also start earlier."""

    def judge(doc, at, group, more):
        lead = np.flatnonzero(_first_of_each(doc, at, group))[group]
        return (doc != doc[lead]) | (at != at[lead])

    return _bucketwise(packed, judge, [np.uint64, np.uint64])


def _buckets(texts: DataFrame) -> int:
    """So many buckets that each gets about ``BUCKET`` words of the table."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(size / 6 / BUCKET) + 1


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: each document without words it repeats.

    A word goes when a window of ``window`` words covers it whose words also
    start earlier, in a smaller doc_id or before it in the same document;
    windows are judged on the input and overlaps count. The first occurrence
    stays. Windows are equal when two 64-bit hashes of their words are.

    Null and empty texts, and those without words, have no words and the
    digest of the empty text. A null doc_id is smaller than all others. Rows
    of one doc_id are one document: a window of one goes if another starts it
    at a smaller place, so repeated rows have the same result. Texts are read
    whole, of any length. An empty table has no rows; further columns are
    ignored.
    """
    block = (window + 1) // 2
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), "text")
    buckets = _buckets(texts)
    found = materialize(hits(blocks(texts, block, buckets), block), "anchor-hits")
    rows = materialize(_settled(_joined_places(texts, found), window), "anchor-rows")
    discard(found)
    live = rows.where("at IS NOT NULL")
    again = materialize(repeats(extended(live, block, window, buckets)), "anchor-repeats")

    def cut(batches):
        for batch in batches:
            columns = _results(batch.column("doc_id"), batch.column("text").to_pylist(), batch.column("at").to_pylist(), window)
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    left = _joined_places(live.drop("at"), again).select("doc_id", "text", "at").mapInArrow(cut, RESULT)
    return rows.where("at IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(left)
