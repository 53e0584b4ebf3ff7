"""Words and shingles as columns, and as numpy arrays over a batch of texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six ASCII white-space characters, as regex classes.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def words(text: Column) -> Column:
    """All words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(text: Column) -> Column:
    """The first 60 bits of the MD5 digest, as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` of the documents in ``_doc`` with ``_left`` as their text and ``n_chars`` recounted.

    Documents travel as one struct, so that no column of theirs clashes with an inner one.
    """
    new = {"text": F.col("_left"), "n_chars": F.char_length("_left").cast("long")}
    return rows.select(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in columns])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values drawn from ``seed``."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True
_BYTE = random_words(256, 11)
_PLACE = random_words(1 << 12, 12) | np.uint64(1)


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of an Arrow string or binary array."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def byte_slices(bounds: np.ndarray, limit: int):
    """Row ranges whose texts hold about ``limit`` bytes together, at least one row each."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_hashes(raw: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of consecutive texts, and each text's word offsets.

    A word's hash is the mixed sum of its bytes' random values, each times a
    value of its place in the word; no Python object is made per word.
    """
    n_docs = len(bounds) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    data = _LOWER[raw] if lower else raw
    inside = ~_IS_GAP[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = bounds[1:-1]
    edge = edge[edge < len(raw)]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    index = np.cumsum(begins) - 1
    place = np.arange(len(raw)) - starts[np.maximum(index, 0)]
    value = _BYTE[data] * (_PLACE[place & 4095] + (place >> 12).astype(np.uint64))
    value[~inside] = 0
    hashes = mix(np.add.reduceat(value, starts))
    return hashes, np.searchsorted(starts, bounds)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, salt in enumerate(random_words(width, 13)):
        total = total * GOLDEN + mix(hashes[i : i + n] ^ salt)
    return mix(total)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; the whole sequence is one when it is shorter."""
    if not len(hashes):
        return hashes
    if len(hashes) < width:
        return window_hashes(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(window_hashes(hashes, width))
