"""Cross-entropy difference of documents under matched n-gram models.

Documents are written in chunks of some megabytes. A chunk sends each of its
word pairs and words once, dealt by hash into buckets; a bucket adds up the
counts of all chunks and answers each chunk with the totals, in the order in
which the chunk asked, so no key travels back. A chunk meets its answers and
scores its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.text import GOLDEN, mix, string_buffers, word_hashes
from docloom.session import materialize, with_conf

# Words that the uniform distribution covers at least.
WORD_BITS = 18
START = np.uint64(0x243F6A8885A308D3)
# Bytes of text of a chunk, and words meant for a bucket.
CHUNK = 1 << 22
BUCKET = 1 << 20
# A file of the written texts is read by one task, so no chunk is cut in two.
_WHOLE_FILES = {"spark.sql.files.maxPartitionBytes": str(1 << 61), "spark.sql.files.openCostInBytes": str(1 << 61)}
# A packed row has some 30 KB, a text some KB: a worker gets few at a time, not ten thousand.
_FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}
_PACKED = "chunk long, bucket int, pairs binary, pair_counts binary, words binary, word_counts binary"
_ANSWERS = "chunk long, bucket int, pair_counts binary, word_counts binary, n_words long, background long, target long"


def _classes(raw: np.ndarray, bounds: np.ndarray):
    """64-bit hashes of each word, the word before it (or the start) and the pair, and offsets of the texts."""
    words, at = word_hashes(raw, bounds)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    firsts = at[:-1][np.diff(at) > 0]
    before[firsts] = START
    pair = mix(before * GOLDEN + words)
    return words.view(np.int64), before.view(np.int64), pair.view(np.int64), at


def _written(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(chunk, doc_id, target, text): all rows, written once with the number of their chunk."""

    def run(batches):
        part = size = None
        for batch in batches:
            lengths = np.diff(string_buffers(batch.column("text"))[1])
            rows, chunk = batch.column("_row").to_numpy(), np.empty(len(lengths), np.int64)
            for i, length in enumerate(lengths.tolist()):
                if part is None or size + length > CHUNK:
                    part, size = int(rows[i]), 0
                size += length
                chunk[i] = part
            names = ["doc_id", "target", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(chunk), *[batch.column(c) for c in names]], names=["chunk", *names])

    # Always the same join: labels grow with the documents, so they are never broadcast.
    marked = docs.select("doc_id", "text").join(good.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    target = F.coalesce("target", F.lit(False)).alias("target")
    rows = marked.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), target, "text")
    return materialize(rows.mapInArrow(run, "chunk long, doc_id long, target boolean, text string"), "lm-texts", "zstd")


def _chunks(batches):
    """(chunk, rows) of batches that are ordered by chunk."""
    held, chunk = [], None
    for batch in batches:
        own = batch.column("chunk").to_numpy()
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else []
        for a, b in zip(edge, [*edge[1:], len(own)]):
            if own[a] != chunk and held:
                yield chunk, pa.Table.from_batches(held)
                held = []
            chunk = own[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield chunk, pa.Table.from_batches(held)


def _planes(counts: np.ndarray) -> bytes:
    """Longs as the first bytes of all, then the second ones, and so on: small numbers compress to their first."""
    return np.ascontiguousarray(counts, np.int64).reshape(-1).view(np.uint8).reshape(-1, 8).T.tobytes()


def _longs(planes: bytes, columns: int) -> np.ndarray:
    flat = np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view(np.int64).reshape(-1)
    return flat.reshape(columns, -1)


def _bucketed(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys ordered by bucket and value, their buckets, and the place of each of ``keys`` among them."""
    once, which = np.unique(keys.view(np.uint64), return_inverse=True)
    bucket = ((once >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return once[order], bucket[order], place[which]


class _Chunk:
    """The words of a chunk's texts; all follows from the set of its texts, in whatever order they come."""

    def __init__(self, texts: pa.ChunkedArray, buckets: int):
        raw, bounds = string_buffers(texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0))
        self.word, self.before, self.pair, at = _classes(raw, bounds)
        self.many = np.diff(at)
        self.owner = np.repeat(np.arange(len(self.many)), self.many)
        self.pairs, self.pair_bucket, self.pair_at = _bucketed(self.pair, buckets)
        self.words, self.word_bucket, places = _bucketed(np.concatenate([self.word, self.before]), buckets)
        self.word_at, self.before_at = places[: len(self.word)], places[len(self.word) :]

    def asked(self, target: np.ndarray):
        """(bucket, pairs, their counts, words, their counts): of all and of the target documents."""
        inside = target[self.owner]

        def counts(place, n):
            return [np.bincount(place, minlength=n), np.bincount(place[inside], minlength=n)]

        pairs = np.stack(counts(self.pair_at, len(self.pairs)))
        words = np.stack(counts(self.word_at, len(self.words)) + counts(self.before_at, len(self.words)))
        for bucket in np.union1d(self.pair_bucket, self.word_bucket).tolist():
            p, w = (slice(*np.searchsorted(b, [bucket, bucket + 1])) for b in (self.pair_bucket, self.word_bucket))
            yield bucket, self.pairs[p].tobytes(), _planes(pairs[:, p]), self.words[w].tobytes(), _planes(words[:, w])


def _asked(texts: DataFrame, buckets: int) -> DataFrame:
    """What each chunk sends to each bucket."""

    def run(batches):
        for chunk, table in _chunks(batches):
            target = np.array(table.column("target").to_pylist(), bool)
            rows = list(_Chunk(table.column("text"), buckets).asked(target))
            if rows:
                kinds = [pa.int32(), *[pa.binary()] * 4]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                names = ["chunk", "bucket", "pairs", "pair_counts", "words", "word_counts"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), chunk)), *columns], names=names)

    return texts.select("chunk", "target", "text").mapInArrow(run, _PACKED)


def _totals(keys: list[bytes], counts: list[bytes], columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The summed counts of each distinct key, and those of the keys of each chunk."""
    own = [np.frombuffer(k, np.uint64) for k in keys]
    once, which = np.unique(np.concatenate(own), return_inverse=True)
    given = np.concatenate([_longs(c, columns) for c in counts], axis=1)
    total = np.zeros((columns, len(once)), np.int64)
    for k in range(columns):
        np.add.at(total[k], which, given[k])
    return total, [total[:, w] for w in np.split(which, np.cumsum([len(k) for k in own])[:-1])]


def _answered(asked: DataFrame) -> DataFrame:
    """The totals for each chunk, in the order of its keys; a bucket's first row has its number of words and their counts."""

    def answers(held):
        rows = pa.Table.from_batches(held)
        keys = {c: rows.column(c).to_pylist() for c in ("chunk", "bucket", "pairs", "pair_counts", "words", "word_counts")}
        _, pairs = _totals(keys["pairs"], keys["pair_counts"], 2)
        total, words = _totals(keys["words"], keys["word_counts"], 4)
        sums = [int((total[0] > 0).sum()), int(total[0].sum()), int(total[1].sum())]
        for i, (chunk, bucket, p, w) in enumerate(zip(keys["chunk"], keys["bucket"], pairs, words)):
            row = [chunk, bucket, _planes(p), _planes(w), *(sums if i == 0 else (0, 0, 0))]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 3]
            names = ["chunk", "bucket", "pair_counts", "word_counts", "n_words", "background", "target"]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    def run(batches):
        held, bucket = [], None
        for batch in batches:
            own = batch.column("bucket").to_numpy()
            edge = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else []
            for a, b in zip(edge, [*edge[1:], len(own)]):
                if own[a] != bucket and held:
                    yield from answers(held)
                    held = []
                bucket = own[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from answers(held)

    dealt = asked.repartition("bucket").sortWithinPartitions("bucket")
    with with_conf(asked.sparkSession, {**_WHOLE_FILES, **_FEW_ROWS}):
        return materialize(dealt.mapInArrow(run, _ANSWERS), "lm-answers", "zstd")


def _counted(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each place's key is in its document, and one place of each."""
    order = np.lexsort((key, owner))
    new = np.append(True, (np.diff(owner[order]) != 0) | (np.diff(key[order]) != 0))
    n = np.diff(np.append(np.flatnonzero(new), len(order)))
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(n, n)
    return out, order[np.flatnonzero(new)]


def _losses(chunk: _Chunk, pairs: np.ndarray, words: np.ndarray, target: np.ndarray, totals: dict[str, int], strength: float):
    """Minus log probability of each document's words in the target's and in the background's model, without its own counts.

    A pair's counts are mixed with the word's frequency as ``strength``
    pseudo-counts; that frequency with the uniform one over all words. The
    background's counts are scaled to the total that the target has.
    """
    n, once = _counted(chunk.owner, chunk.pair)
    owner, n = chunk.owner[once], n[once]
    n_word, n_before = (_counted(chunk.owner, key)[0][once] for key in (chunk.word, chunk.before))
    pair, word, before = chunk.pair_at[once], chunk.word_at[once], chunk.before_at[once]
    n_all, own = chunk.many[owner], target[owner]

    def loss(side, less, total, scale):
        single = ((words[side, word] - n_word * less) * scale + 0.5) / (total + 0.5 * totals["size"])
        seen = (pairs[side, pair] - n * less) * scale + strength * single
        value = -np.log(seen / ((words[2 + side, before] - n_before * less) * scale + strength))
        return np.bincount(owner, n * value, len(chunk.many))

    rest = totals["background"] - n_all
    scale = np.where(rest > 0, totals["target"] / np.maximum(rest, 1), 1.0)
    return loss(1, own, totals["target"] - n_all * own, 1.0), loss(0, True, float(totals["target"]), scale)


def _scored(texts: DataFrame, answers: DataFrame, buckets: int, totals: dict[str, int], strength: float) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss): each chunk's texts meet the totals of their words."""
    none = lambda *columns: [F.lit(None).cast(kind).alias(c) for c, kind in columns]
    left = answers.select("chunk", "bucket", "pair_counts", "word_counts", *none(("doc_id", "long"), ("target", "boolean"), ("text", "string")))
    right = texts.select("chunk", *none(("bucket", "int"), ("pair_counts", "binary"), ("word_counts", "binary")), "doc_id", "target", "text")
    names = ["doc_id", "n_tokens", "target_loss", "background_loss"]

    def run(batches):
        for _, table in _chunks(batches):
            asked = table.column("bucket").is_valid()
            given, table = table.filter(asked), table.filter(pa.compute.invert(asked))
            chunk = _Chunk(table.column("text"), buckets)
            target = np.array(table.column("target").to_pylist(), bool)
            sums = [np.zeros(len(table))] * 2
            if len(chunk.owner):
                pairs, words = (
                    np.concatenate([_longs(x, k) for x in given.column(c).to_pylist()], axis=1)
                    for c, k in (("pair_counts", 2), ("word_counts", 4))
                )
                sums = _losses(chunk, pairs, words, target, totals, strength)
            blank = chunk.many == 0
            means = [pa.array(s / np.maximum(chunk.many, 1), mask=blank) for s in sums]
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(chunk.many), *means], names=names)

    dealt = left.unionByName(right).repartition("chunk").sortWithinPartitions("chunk", F.col("bucket").asc_nulls_last())
    return dealt.mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double")


def score(docs: DataFrame, labels: DataFrame, strength: float = 64.0) -> DataFrame:
    """Cross-entropy difference: doc_id, n_tokens, target_loss, background_loss, score.

    The target are the documents labelled as good and not toxic, the
    background all documents; both models are word pair models over all words
    of all documents, with the same smoothing, and the background's counts
    are scaled to the target's total. No document is scored by its own counts:
    they are taken out of the background, and of the target where it is one of
    its documents, so a label alone changes no score. Words are told apart by 64-bit hashes. Losses are means per word, ``score`` is
    target minus background: the lower, the more like the target.

    Null, empty and white-space texts have no words: losses and score are
    null. Without labelled documents both losses are of empty models. A label
    row without id is ignored, of repeated ones the best quality counts unless
    any is toxic. Repeated rows are scored each for itself; an empty table
    gives no rows; further columns are ignored.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        ((F.max("quality") >= 1) & (F.coalesce(F.max("toxic"), F.lit(0)) < 1)).alias("target")
    ).where("target")
    texts = _written(docs, good)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size / 6 / BUCKET) + 1
    answers = _answered(_asked(texts, buckets))
    n, background, target = answers.agg(F.sum("n_words"), F.sum("background"), F.sum("target")).first()
    totals = {"size": max(n or 0, 1 << WORD_BITS), "background": background or 0, "target": target or 0}
    with with_conf(docs.sparkSession, _FEW_ROWS):
        scored = materialize(_scored(texts, answers, buckets, totals, strength), "lm-scores")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
