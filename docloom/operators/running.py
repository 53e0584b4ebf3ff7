"""Running totals and ordinals that never put one whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, Column],
    block: int = 4096,
    levels: int = 1,
) -> DataFrame:
    """Inclusive running sums of ``values`` per key, in the order of ``order``.

    ``order`` is an integral column, unique within a key. A key is cut into
    blocks of ``block`` consecutive order values, so a window task holds at
    most ``block`` rows of it however hot the key is. The totals of the
    blocks, one row each, are then summed up. With more ``levels`` that is
    done in blocks as well: sparse order values, such as timestamps, make
    many blocks, and each level divides their number range by ``block``.
    The block of a row depends on its own values only, so recomputed tasks
    agree.
    """
    blk = f"_blk{levels}"
    window = Window.partitionBy(*keys, *([blk] if levels else [])).orderBy(order)
    window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = [c for c in df.columns if c not in values]
    if not levels:
        return df.select(*rest, *[F.sum(v).over(window).alias(n) for n, v in values.items()])
    tagged = df.withColumns(
        {blk: F.floor(F.col(order) / F.lit(block)), **{f"_v_{n}": v for n, v in values.items()}}
    )
    totals = tagged.groupBy(*keys, blk).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    reached = running_total(
        totals, keys, blk, {f"_r_{n}": F.col(f"_t_{n}") for n in values}, block, levels - 1
    )
    before = reached.select(
        *keys, blk, *[(F.col(f"_r_{n}") - F.col(f"_t_{n}")).alias(f"_o_{n}") for n in values]
    )
    local = tagged.withColumns({n: F.sum(f"_v_{n}").over(window) for n in values})
    joined = local.join(before, [*keys, blk])
    return joined.select(*rest, *[(F.col(n) + F.col(f"_o_{n}")).alias(n) for n in values])


def ordinal(df: DataFrame, keys: list[str], order: str, name: str = "ordinal", block: int = 4096) -> DataFrame:
    """1-based rank of each row within its key (``order`` unique per key)."""
    return running_total(df, keys, order, {name: F.lit(1).cast("long")}, block)
