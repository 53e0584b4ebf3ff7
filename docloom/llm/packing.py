"""Best-fit packing of tokenised documents by length patterns."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.running import running_total
from docloom.session import materialize

END = 0
_encoders: dict[int, object] = {}


def _encoder(vocabulary: bytes, pattern: str):
    """One encoder per Python worker."""
    key = hash((vocabulary, pattern))
    if key not in _encoders:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding(
            "packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
    return _encoders[key]


def read_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The byte-level vocabulary as ranks: the same ids as ``byte_bpe_50k.json``."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def pieces(docs: DataFrame, limit: int = 2048, vocabulary: bytes | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token runs to be packed.

    A document is its ids and the end id. Longer ones are cut from the end,
    so only the first piece is shorter than ``limit``.
    """
    import public_tokenizers

    # Sent to the tasks, which need no tokenizer files: about a megabyte, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary or read_vocabulary(), public_tokenizers.PATTERN))

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(*shared.value)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            rows = []
            for k, doc_id in enumerate(ids):
                tokens = np.array([*encoder.encode_ordinary(texts[k].as_py() or ""), END], dtype="<u4")
                first = len(tokens) % limit or limit
                at = [0, *range(first, len(tokens) + 1, limit)]
                for i, (a, b) in enumerate(zip(at, at[1:])):
                    rows.append((doc_id, i, a, b - a, zlib.crc32(tokens[a:b].tobytes())))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(present: np.ndarray, limit: int, step: int = 32) -> np.ndarray:
    """Length patterns of two and three pieces that fill a sequence exactly (0: no third piece).

    The shortest of three is a multiple of ``step``, which keeps their number
    linear in ``limit``; every length must be present.
    """
    low = np.arange(1, limit // 2 + 1)
    found = [np.stack([limit - low, low, np.zeros_like(low)], axis=1)]
    for c in range(step, limit // 3 + 1, step):
        b = np.arange(c, (limit - c) // 2 + 1)
        found.append(np.stack([limit - b - c, b, np.full_like(b, c)], axis=1))
    table = np.concatenate(found)
    seen = np.concatenate([[True], present[1:]])
    return table[seen[table].all(axis=1)]


def non_negative_fit(table: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, by accelerated projected gradients."""
    if not len(table):
        return np.zeros(0)
    n = len(histogram)

    def use(x):
        out = sum(np.bincount(table[:, j], x, n) for j in range(3))
        out[0] = 0
        return out

    wanted = histogram.astype(float).copy()
    wanted[0] = 0
    degree = use(np.ones(len(table)))
    bound = 3 * max(degree.max(), 1.0)
    x = y = np.zeros(len(table))
    t = 1.0
    for _ in range(rounds):
        slope = use(y) - wanted
        slope[0] = 0
        new = np.maximum(0, y - slope[table].sum(axis=1) / bound)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def packing_plan(histogram: np.ndarray, limit: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset): where the pieces of each length go.

    The plan works on the histogram alone (``limit`` numbers), so its cost
    does not grow with the corpus. Patterns come first, with the rounded
    counts of the fit; what is left goes, longest first, into the fullest
    sequence that still has room.
    """
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    plan: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        plan.append((length, int(used[length]), count, first, offset))
        used[length] += count
        left[length] -= count

    if left[limit]:
        place(limit, int(left[limit]), 0, 0)
        sequences = int(used[limit])
    table = patterns(left > 0, limit)
    repeat = np.rint(non_negative_fit(table, left)).astype(np.int64)
    for k in np.argsort(-repeat, kind="stable"):
        if repeat[k] < 1:
            break
        parts = [int(v) for v in table[k] if v]
        count = min(int(repeat[k]), *(int(left[v] // parts.count(v)) for v in parts))
        if count < 1:
            continue
        offset = 0
        for v in parts:
            place(v, count, sequences, offset)
            offset += v
        sequences += count

    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, how many)
    sizes: list[int] = []

    def offer(free: int, first: int, count: int) -> None:
        if free and count:
            if free not in room:
                room[free] = []
                insort(sizes, free)
            room[free].append((first, count))

    for length in range(limit - 1, 0, -1):
        while left[length]:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                fit = limit // length
                count = max(1, int(left[length]) // fit)
                fit = min(fit, int(left[length]) // count)
                for i in range(fit):
                    place(length, count, sequences, i * length)
                offer(limit - fit * length, sequences, count)
                sequences += count
                continue
            free = sizes[at]
            first, count = room[free].pop()
            take = min(count, int(left[length]))
            place(length, take, first, limit - free)
            offer(free, first + take, count - take)
            offer(free - length, first, take)
            if not room[free]:
                del room[free]
                sizes.remove(free)
    return plan


def pack(docs: DataFrame, limit: int = 2048, vocabulary: bytes | None = None) -> DataFrame:
    """Each piece's sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces are written once; their lengths' histogram (``limit`` numbers)
    goes to the driver, which plans by pattern. A piece finds its sequence
    from its length and its rank among the pieces of that length, which is
    counted in blocks, so a length that a third of all pieces share is no hot
    group. The plan, which depends on ``limit`` alone, is broadcast.

    Null and empty texts are the end id alone. Repeated rows are packed each
    for itself; a null doc_id stays null. An empty table gives no rows;
    further columns are ignored.
    """
    spark = docs.sparkSession
    found = pieces(docs, limit, vocabulary).withColumn("_row", F.monotonically_increasing_id())
    found = materialize(found, "pack-pieces")
    histogram = np.zeros(limit + 1, np.int64)
    for row in found.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    plan = spark.createDataFrame(
        packing_plan(histogram, limit),
        "length long, _from long, _count long, _first long, offset long",
    )
    ranked = running_total(found, ["length"], "_row", {"_rank": F.lit(1).cast("long")}, levels=2)
    at = F.col("_rank") - 1
    inside = (at >= F.col("_from")) & (at < F.col("_from") + F.col("_count"))
    return (
        ranked.join(F.broadcast(plan.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & inside)
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("_first") + at - F.col("_from")).alias("sequence_id"), "offset",
        )
    )
