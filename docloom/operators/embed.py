"""Text embedding: the default without a model, and the hook for one."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from .worker import once_per_worker

# Texts in, one vector per text out.
Model = Callable[[list[str]], np.ndarray]

HASH_DIM = 64
# Distinct tokens whose bucket a worker remembers; more would not stay in a cache.
REMEMBERED = 1 << 14


# What the rounds of MD5 add and how far they rotate (RFC 1321).
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
# Bytes that fit one block of MD5 with its mark and length.
_ONE_BLOCK = 55


def _first_words(tokens: pa.Array) -> np.ndarray:
    """The first eight hex digits of each token's MD5 as a number, for tokens of one block, all in step."""
    n, ends = len(tokens), np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1]
    length = np.diff(ends)
    block = np.zeros((n, 64), np.uint8)
    to = np.arange(n) * 64
    data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    block.ravel()[np.repeat(to - (ends[:-1] - ends[0]), length) + np.arange(len(data))] = data
    block.ravel()[to + length] = 0x80
    block.view(np.uint64)[:, 7] = length * 8
    words = np.ascontiguousarray(block.view("<u4").T)
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, x) for x in start)
    mixed, turned = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(d, np.bitwise_and(b, np.bitwise_xor(c, d, out=mixed), out=mixed), out=mixed)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(c, np.bitwise_and(d, np.bitwise_xor(b, c, out=mixed), out=mixed), out=mixed)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(np.bitwise_xor(b, c, out=mixed), d, out=mixed)
        else:
            g = 7 * i % 16
            np.bitwise_xor(c, np.bitwise_or(b, np.invert(d, out=mixed), out=mixed), out=mixed)
        mixed += a
        mixed += np.uint32(_SINES[i])
        mixed += words[g]
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(mixed, np.uint32(32 - turn), out=turned)
        np.left_shift(mixed, np.uint32(turn), out=mixed)
        mixed |= turned
        np.add(mixed, b, out=a)
        a, b, c, d = d, a, b, c
    return (a + start[0]).astype("<u4").view(">u4").astype(np.int64)


class Buckets(dict):
    """The bucket of each lower-case token (UTF-8): its MD5 modulo the dimensions; many are remembered.

    Tokens that are not are hashed together (``_first_words``).
    """

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        return -1

    def _at(self, tokens: pa.Array) -> np.ndarray:
        """The bucket of each of different tokens."""
        known = tokens.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.__getitem__, known), np.int64, len(known))
        new = np.flatnonzero(at < 0)
        if len(new):
            asked = tokens.take(pa.array(new))
            short = pa.compute.less_equal(pa.compute.binary_length(asked), _ONE_BLOCK).to_numpy(zero_copy_only=False)
            at[new[short]] = _first_words(asked.filter(pa.array(short))) % self.dim
            for i in new[~short].tolist():
                at[i] = int(hashlib.md5(known[i]).hexdigest()[:8], 16) % self.dim
            room = new[: max(0, REMEMBERED - len(self))].tolist()
            self.update(zip([known[i] for i in room], at[room].tolist()))
        return at

    def vectors(self, texts: list[bytes]) -> np.ndarray:
        """Unit vectors of token counts; tokens are cut at the ASCII white space of ``tokens``.

        A text that comes again, as that of a chunk that is not cut further, is
        counted once, and a token of several texts is looked up once.
        """
        first: dict[bytes, int] = {}
        row = np.fromiter((first.setdefault(text, len(first)) for text in texts), np.int64, len(texts))
        cut = pa.compute.ascii_split_whitespace(pa.array(list(first), pa.large_binary()).view(pa.large_string()))
        found = cut.flatten().view(pa.large_binary()).dictionary_encode()
        token = found.indices.to_numpy()
        at = np.repeat(np.arange(len(first)) * self.dim, np.diff(cut.offsets.to_numpy())) + self._at(found.dictionary)[token]
        blank = pa.compute.index(found.dictionary, pa.scalar(b"", pa.large_binary())).as_py()
        if blank >= 0:
            at = at[token != blank]
        out = np.bincount(at, minlength=len(first) * self.dim).reshape(len(first), self.dim).astype(np.float64)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1.0, norm))[row]


def _vector_column(model_of: Callable[[], Callable], batch: int, binary: bool) -> Callable[[Column], Column]:
    """Texts to vectors, ``batch`` at a time; no more texts than that are Python objects at once."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of()
        for texts in batches:
            lengths, values = [np.zeros(1, np.int32)], [np.zeros(0, np.float32)]
            for at in range(0, len(texts), batch):
                some = texts.slice(at, batch)
                if binary:
                    some = some.cast(pa.binary())
                for row in model(some.fill_null(b"" if binary else "").to_pylist()):
                    values.append(np.asarray(row, np.float32))
                    lengths.append([len(row)])
            ends = np.cumsum(np.concatenate(lengths), dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))

    return embed


def embed_hash(df: DataFrame, text: str = "text", dim: int = HASH_DIM) -> DataFrame:
    """Add ``embedding``: the unit vector of lower-case token counts by MD5 bucket, in Arrow batches.

    A worker hashes a token once and remembers its bucket, where column
    functions would hash each of a text's tokens anew.
    """
    buckets = once_per_worker(lambda: Buckets(dim).vectors)
    return df.withColumn("embedding", _vector_column(buckets, fixed.EMBED_BATCH, True)(F.lower(F.col(text))))


def model_column(load: Callable[[], Model], batch: int = fixed.EMBED_BATCH) -> Callable[[Column], Column]:
    """A column function for a model.

    ``load`` runs once per Python worker, and the model gets ``batch`` texts
    at a time.
    """
    return _vector_column(once_per_worker(load), batch, False)


def embedder(load: Callable[[], Model], batch: int = fixed.EMBED_BATCH) -> Callable[..., DataFrame]:
    """``embed(df, text="text")`` adding ``embedding`` by a model."""
    column = model_column(load, batch)
    return lambda df, text="text": df.withColumn("embedding", column(F.col(text)))


def hash_model(dim: int = HASH_DIM) -> Callable[[], Model]:
    """A model that needs no files: unit vectors of token counts by MD5 bucket."""

    def load() -> Model:
        buckets = Buckets(dim)
        return lambda texts: buckets.vectors([text.lower().encode() for text in texts])

    return load
