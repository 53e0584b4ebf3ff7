"""Sketches of ids: a Bloom filter of 64-bit words with four bits an id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ids that share a word of a sketch.
WORD_IDS = 4
# Words of a sketch that goes to all tasks at most (16 bytes each).
SIEVE_WORDS = 1 << 20


def mask(column: str) -> Column:
    """Four of 64 bits, drawn from the hash of an id."""
    bits = [F.expr(f"shiftleft(1L, cast(shiftright(xxhash64({column}, 1L), {6 * i}) & 63 AS INT))") for i in range(4)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def slot(column: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(slots)).cast("long")


def sieve(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` is none of ``ids.id``, before any of them is moved.

    The ids' sketch goes to every task: at most ``SIEVE_WORDS`` words, so more
    ids only let more rows through. A join with the ids decides. Pass a written
    frame of ids, as it is read twice.
    """
    words = min(ids.count() // WORD_IDS + 1, SIEVE_WORDS)
    sketch = ids.groupBy(slot("id", words).alias("_word")).agg(F.bit_or(mask("id")).alias("_bits"))
    marked = rows.withColumns({"_slot": slot(column, words), "_mask": mask(column)})
    near = (F.col("_slot") == F.col("_word")) & (F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
    return marked.join(F.broadcast(sketch), near, "left_semi").drop("_slot", "_mask")
