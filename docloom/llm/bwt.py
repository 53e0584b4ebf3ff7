"""Repeated passages across documents, by merging positional Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.text import GOLDEN, MIX_A, MIX_B, mix, random_words, string_buffers, with_text
from docloom.session import materialize

GRAM = 64
SLICE = 1 << 18
_VALUE = random_words(256, 31)


def _powers(base: np.uint64, n: int) -> list[np.uint64]:
    """base ** 1, 2, 4, ... as many as fit below ``n``, modulo 2 ** 64."""
    out, power = [], int(base)
    while 1 << len(out) < n:
        out.append(np.uint64(power))
        power = power * power % (1 << 64)
    return out


def rolling(raw: np.ndarray, widths: tuple[int, ...], base: np.uint64 = GOLDEN) -> list[np.ndarray]:
    """For each width, the hash of each run of so many bytes, from runs of doubled length."""
    out: list[np.ndarray | None] = [None] * len(widths)
    taken = [0] * len(widths)
    now = _VALUE[raw]
    for k, power in enumerate(_powers(base, max(widths) + 1)):
        size = 1 << k
        for i, width in enumerate(widths):
            if width & size:
                if out[i] is None:
                    out[i] = now
                else:  # the run so far, then this one
                    n = len(raw) - taken[i] - size + 1
                    out[i] = out[i][:n] * np.uint64(pow(int(base), size, 1 << 64)) + now[taken[i] : taken[i] + n]
                taken[i] += size
        if taken != list(widths):
            now = now[:-size] * power + now[size:]
    return [(h ^ (h >> np.uint64(32))) * MIX_A for h in out]


def sliding(op, x: np.ndarray, width: int, fill) -> np.ndarray:
    """``op`` over each run of ``width`` values, from running values of blocks."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    table = np.full(blocks * width, fill, x.dtype)
    table[: len(x)] = x
    table = table.reshape(blocks, width)
    ahead = op.accumulate(table, axis=1).ravel()
    back = op.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[width - 1 : width - 1 + n])


def anchored_runs(raw: np.ndarray, bounds: np.ndarray, width: int, gram: int = GRAM):
    """Runs of window starts with one anchor: (text, start, starts, anchor minus start, key, digest) arrays.

    The anchor of a window of ``width`` bytes is its smallest gram hash, the
    leftmost of equal ones. Equal windows have equal anchors at equal places,
    so windows can repeat only among runs of one key, aligned at the anchor.
    Each start belongs to exactly one run. The digest is of all bytes of the
    run, as its first and last window overlap. Long texts are read in slices.
    """
    window = width - gram + 1
    found = []
    for at in range(0, max(len(raw) - width + 1, 0), SLICE):
        part = raw[at : at + SLICE + width - 1]
        h, whole = rolling(part, (gram, width))
        low = sliding(np.minimum, h, window, np.iinfo(np.uint64).max)
        valid = np.ones(len(low), bool)
        first, last = np.searchsorted(bounds, [at, at + len(low) + width], side="right")
        for end in bounds[max(first, 1) : last]:
            valid[max(end - at - width + 1, 0) : max(end - at, 0)] = False
        starts = np.flatnonzero(valid)
        if not len(starts):
            continue
        value = low[starts]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (starts[1:] != starts[:-1] + 1) | (value[1:] != value[:-1])
        begin = np.flatnonzero(fresh)
        s0 = starts[begin]
        s1 = starts[np.append(begin[1:], len(starts)) - 1]
        key = value[begin]
        zero = np.zeros(window - 1, np.uint64)
        high = sliding(np.maximum, np.concatenate([zero, low, zero]), window, np.uint64(0))
        place = np.flatnonzero(high == h)
        ranks, rank = np.unique(h[place], return_inverse=True)
        order = np.lexsort((place, rank))
        joint, place = (rank[order].astype(np.int64) << 32) | place[order], place[order]
        own = np.searchsorted(ranks, key).astype(np.int64) << 32
        lo, hi = np.searchsorted(joint, own | s0), np.searchsorted(joint, own | s1)
        many = hi - lo + 1
        run = np.repeat(np.arange(len(s0)), many)
        step = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
        anchor = place[lo[run] + step]
        begins = np.where(step == 0, s0[run], place[np.maximum(lo[run] + step - 1, 0)] + 1)
        ends = np.minimum(anchor, s1[run])
        text = np.searchsorted(bounds, begins + at, side="right") - 1
        shape = (ends - begins).astype(np.uint64) * MIX_B + (anchor - begins).astype(np.uint64)
        digest = mix(mix(whole[begins] + shape * GOLDEN) + whole[ends])
        found.append(
            (text, begins + at - bounds[text], ends - begins + 1, anchor - begins, key[run].view(np.int64), digest.view(np.int64))
        )
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*found))


class Shard:
    """Aligned strings and their positional Burrows-Wheeler transform.

    ``columns`` gives, for each column, the symbols in the order of the
    reversed prefixes before it (0: the string has no byte there) and that
    order itself; strings of one key stay together.
    """

    def __init__(self, rows: np.ndarray, key: np.ndarray, begin: np.ndarray, before: np.ndarray, size: np.ndarray):
        self.rows, self.key, self.begin, self.before, self.size = rows, key, begin, before, size
        self.order = np.arange(len(rows))

    def column(self, data: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of column ``c`` and their rows; then the order moves on by one column."""
        i = c + self.before[self.order]
        inside = (i >= 0) & (i < self.size[self.order])
        symbol = np.where(inside, data[np.where(inside, self.begin[self.order] + i, 0)].astype(np.int64) + 1, 0)
        rows = self.rows[self.order]
        self.order = self.order[np.argsort(self.key[self.order] * 512 + symbol, kind="stable")]
        return symbol, rows


def merge_shards(data: np.ndarray, shards: list[Shard], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start in the row) of every window that occurs twice among strings of one key.

    ``interleave`` says which shard each place of the merged order comes from.
    It is refined column by column: the symbols are taken from the shards'
    transforms in its order and sorted stably within their key, which needs no
    comparison of strings. ``since`` is the column from which neighbours agree
    (the common prefix, read backwards); two neighbours that have agreed for
    ``width`` columns bound a repeated interval.
    """
    key = np.concatenate([s.key for s in shards])
    interleave = np.concatenate([np.full(len(s.rows), k) for k, s in enumerate(shards)])
    order = np.argsort(key, kind="stable")
    key, interleave = key[order], interleave[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    low = -max(int(s.before.max()) for s in shards)
    high = max(int((s.size - s.before).max()) for s in shards)
    since = np.full(len(key) + 1, low, np.int64)
    since[:-1][first] = high + width
    symbol, row = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    found_row, found_end = [], []
    for c in range(low, high):
        for k, shard in enumerate(shards):
            here = interleave == k
            symbol[here], row[here] = shard.column(data, c)
        move = np.argsort(key * 512 + symbol, kind="stable")
        interleave, sorted_symbol, row = interleave[move], symbol[move], row[move]
        same = ~first
        same[1:] &= sorted_symbol[1:] == sorted_symbol[:-1]
        live = np.flatnonzero(same)
        fresh = np.full(len(key) + 1, high + width, np.int64)
        if len(live):
            spans = np.stack([move[live - 1] + 1, move[live] + 1], axis=1).ravel()
            fresh[live] = np.maximum.reduceat(since, spans)[::2]
        fresh[:-1][~first & ~same] = c + 1
        fresh[:-1][~first & (sorted_symbol == 0)] = c + 1
        since = fresh
        near = np.minimum(since[:-1], since[1:]) <= c + 1 - width
        if near.any():
            found_row.append(row[near].copy())
            found_end.append(np.full(int(near.sum()), c + 1))
    if not found_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_row), np.concatenate(found_end)


def repeated_starts(data, bounds, key, before, width: int, shard_bytes: int = 1 << 20):
    """(row, start) of repeated windows of the given strings, which lie one after the other in ``data``."""
    size = np.diff(bounds)
    _, key = np.unique(key, return_inverse=True)
    shards, first = [], 0
    while first < len(key):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + shard_bytes, side="right")) - 1)
        rows = np.arange(first, min(last, len(key)))
        shards.append(Shard(rows, key[rows], bounds[:-1][rows], before[rows], size[rows]))
        first = last
    row, end = merge_shards(data, shards, width)
    return row, end - width + before[row]


def _intervals(start: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Union of [s, s + width) over sorted or unsorted starts."""
    start = np.unique(start)
    if not len(start):
        return []
    gap = np.flatnonzero(np.diff(start) > width) + 1
    return list(zip(start[np.append(0, gap)].tolist(), (start[np.append(gap, len(start)) - 1] + width).tolist()))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("text", text).withColumn("_t", F.unhex(F.md5("text")))


def _runs(texts: DataFrame, width: int) -> DataFrame:
    """(_t, key, digest, n, before, at): the runs of each text, equal ones as one row with all their places."""

    def run(batches):
        for batch in batches:
            raw, bounds = string_buffers(batch.column("text"))
            text, at, n, before, key, digest = anchored_runs(raw, bounds, width)
            order = np.lexsort((at, digest, key, text))
            text, at, n, before, key, digest = (x[order] for x in (text, at, n, before, key, digest))
            fresh = np.ones(len(text), bool)
            fresh[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
            first = np.flatnonzero(fresh)
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_t").take(pa.array(text[first])), *(pa.array(x[first]) for x in (key, digest, n, before)), places],
                names=["_t", "key", "digest", "n", "before", "at"],
            )

    schema = "_t binary, key long, digest long, n long, before long, at array<long>"
    return texts.select("_t", "text").mapInArrow(run, schema)


def _segments(chosen: DataFrame, width: int) -> DataFrame:
    """Bytes of each run; for runs of hot keys, two hashes of each window instead."""

    def run(batches):
        names = ["_t", "key", "other", "at", "before", "bytes"]
        for batch in batches:
            for cells in zip(*(batch.column(c) for c in ("_t", "text", "runs"))):
                t, text, runs = (cell.as_py() for cell in cells)
                data, rows = text.encode(), []
                for r in runs:
                    part = data[r["at"] : r["at"] + r["n"] + width - 1]
                    if r["hot"]:
                        raw = np.frombuffer(part, np.uint8)
                        pair = [rolling(raw, (width,), b)[0].view(np.int64).tolist() for b in (GOLDEN, MIX_A)]
                        rows += [(t, a, b, r["at"] + i, 0, None) for i, (a, b) in enumerate(zip(*pair))]
                    else:
                        rows.append((t, r["key"], None, r["at"], r["before"], part))
                kinds = [pa.binary(), *[pa.int64()] * 4, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return chosen.select("_t", "text", "runs").mapInArrow(
        run, "_t binary, key long, other long, at long, before long, bytes binary"
    )


def _merged(segments: DataFrame, width: int, chunk: int = 1 << 22) -> DataFrame:
    """(_t, start, end) covered by repeated windows; whole keys are merged at a time."""

    def run(batches):
        def solve(table):
            table = table.combine_chunks()
            raw, bounds = string_buffers(table.column("bytes").chunk(0))
            key, before, at = (table.column(c).to_numpy() for c in ("key", "before", "at"))
            row, start = repeated_starts(raw, bounds, key, before, width)
            order = np.argsort(row, kind="stable")
            row, start = row[order], start[order] + at[row[order]]
            cut = np.flatnonzero(np.diff(row)) + 1
            out = [(int(r[0]), *span) for r, s in zip(np.split(row, cut), np.split(start, cut)) if len(r) for span in _intervals(s, width)]
            who, a, b = (list(c) for c in zip(*out)) if out else ([], [], [])
            return pa.RecordBatch.from_arrays(
                [table.column("_t").take(pa.array(who, pa.int64())).combine_chunks(), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
                if out else [pa.array([], k) for k in (pa.binary(), pa.int64(), pa.int64())],
                names=["_t", "start", "end"],
            )

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < chunk:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield solve(table.slice(0, whole))
                table = table.slice(whole)
            held, size = table.to_batches(), table.nbytes
        if held:
            table = pa.Table.from_batches(held)
            if len(table):
                yield solve(table)

    dealt = segments.repartition("key").sortWithinPartitions("key")
    return dealt.select("_t", "key", "at", "before", "bytes").mapInArrow(run, "_t binary, start long, end long")


def repeated_spans(docs: DataFrame, width: int = 400, hot: int = 4096) -> DataFrame:
    """(_t, spans) of each text with bytes to remove; ``_t`` is the text's MD5 digest.

    1. Every window start gets its anchor; runs of starts with one anchor are
       rows. Equal runs are one string with a count: if it occurs twice, all
       of it is repeated. A key with one string only needs no more.
    2. One of each string of the other keys is cut out of its text, aligned
       at the anchor, and dealt by key. Shards of them are transformed and
       merged (``merge_shards``), which finds what different strings share.
    3. Keys with more than ``hot`` strings are not collected: each of their
       windows is a row with a 128-bit hash, counted with partial aggregates.
    """
    texts = _texts(docs.select("doc_id", "text"))
    groups = materialize(texts.groupBy("_t").agg(F.min("doc_id").alias("_first")), "repeat-texts")
    runs = materialize(_runs(texts, width), "repeat-runs")
    mark = F.xxhash64("_t", F.element_at("at", 1))
    strings = runs.groupBy("key", "digest").agg(F.sum(F.size("at")).alias("_n"), F.min(mark).alias("_mark"))
    strings = materialize(strings, "repeat-strings")
    twice = strings.where("_n > 1").select("key", "digest")
    whole = runs.join(twice, ["key", "digest"]).select("_t", "n", "at").distinct()
    span = lambda start, size: F.struct(start.alias("start"), (start + size).alias("end"))
    whole = whole.select("_t", F.transform("at", lambda x: span(x, F.col("n") + (width - 1))).alias("spans"))

    shared = strings.groupBy("key").agg(F.count("*").alias("_k")).where("_k > 1")
    chosen = strings.join(shared.select("key", (F.col("_k") > hot).alias("hot")), "key")
    rows = runs.join(chosen.select("key", "digest", "_mark", "hot"), ["key", "digest"]).where(mark == F.col("_mark"))
    run = F.struct("key", F.element_at("at", 1).alias("at"), "n", "before", "hot")
    rows = rows.groupBy("_t").agg(F.collect_set(run).alias("runs"))
    rows = rows.join(groups, "_t").withColumnRenamed("_t", "_k")
    here = texts.join(rows, (F.col("_t") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    segments = materialize(_segments(here, width), "repeat-segments")
    merged = _merged(segments.where("other IS NULL"), width).select("_t", F.array(F.struct("start", "end")).alias("spans"))
    windows = segments.where("other IS NOT NULL")
    again = windows.groupBy("key", "other").agg(F.count("*").alias("_n")).where("_n > 1").select("key", "other")
    again = windows.join(again, ["key", "other"]).select("_t", F.array(span(F.col("at"), F.lit(width))).alias("spans"))
    found = whole.unionByName(merged).unionByName(again)
    return found.groupBy("_t").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def _unique(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of sorted spans."""
    out: list[list[int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _cut(text: str | None, spans) -> tuple[bytes, int, int, int]:
    data = (text or "").encode()
    spans = _unique([(s["start"], s["end"]) for s in spans or ()])
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    kept.append(data[at:])
    left = b"".join(kept)
    return left, len(data), len(data) - len(left), len(spans)


def _joined(docs: DataFrame, width: int, hot: int) -> DataFrame:
    spans = repeated_spans(docs, width, hot).withColumnRenamed("_t", "_k")
    return _texts(docs).join(spans, F.col("_t") == F.col("_k"), "left")


def remove_repeats(docs: DataFrame, width: int = 400, hot: int = 4096) -> DataFrame:
    """Removed bytes of each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte that a ``width``-byte string covers which also starts anywhere
    else, in this or another document, is removed; strings are judged on the
    input and overlaps count. Null and empty texts have no bytes. Copies and
    repeated rows are other places, so they lose all when they are long
    enough. An empty table gives no rows; further columns are ignored.
    """

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                left, *figures = _cut(text.as_py(), spans.as_py())
                out.append((*figures, hashlib.sha256(left).hexdigest()))
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _joined(own, width, hot).select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def cleaned_documents(docs: DataFrame, width: int = 400, hot: int = 4096) -> DataFrame:
    """The documents with their repeats removed; same columns, ``n_chars`` recounted.

    A character that a removed run cuts in two goes whole. A document that
    loses everything stays with an empty text; null stays null.
    """

    @F.arrow_udf("string")
    def left(text: pa.Array, spans: pa.Array) -> pa.Array:
        cuts = (_cut(t.as_py(), s.as_py())[0] for t, s in zip(text, spans))
        return pa.array([c.decode("utf-8", "ignore") for c in cuts], pa.string())

    own = docs.select(F.struct("*").alias("_doc"), "text", "doc_id")
    joined = _joined(own, width, hot)
    cut = F.when(F.col("spans").isNull(), F.col("_doc.text")).otherwise(left("text", "spans"))
    return with_text(joined.select("_doc", cut.alias("_left")), docs.columns)
