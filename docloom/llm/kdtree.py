"""K-d tree shards of near equal bytes (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.running import running_total
from docloom.session import materialize

BITS = 31
STEP = 12
DIMENSIONS = ("by_size", "by_lang", "by_source", "by_id")


@dataclass
class Node:
    """A box of the tree that is to become ``shards`` shards, from ``first`` on."""

    number: int
    first: int
    shards: int
    dimension: int = 0
    split: int = 0


def _id_place(docs: DataFrame) -> Column:
    """The id as a place in 31 bits: its distance from the smallest id, halved until the largest fits.

    Null ids take part as 0. Ids that share a place are divided by the hash.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    low, high = docs.agg(F.min(key), F.max(key)).first()
    shift = max(0, ((high or 0) - (low or 0)).bit_length() - BITS)
    # As decimals: the distance may pass 2^63.
    wide = key.cast("decimal(20,0)") - F.lit(low or 0).cast("decimal(20,0)")
    return F.floor(wide / F.lit(1 << shift).cast("decimal(20,0)")).cast("long")


def _positions(docs: DataFrame) -> DataFrame:
    """Id, size, checksum, and each metadata value as a place in 31 bits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    top = float((1 << BITS) - 1)
    place = lambda c: F.when(c.isNull(), F.lit(0)).otherwise(F.crc32(c) / 2)
    size = F.octet_length(text) + F.lit(8)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.floor(F.log2(size) / 40 * F.lit(top)).cast("long").alias("by_size"),
        place(F.col("lang")).cast("long").alias("by_lang"),
        place(F.col("source")).cast("long").alias("by_source"),
        _id_place(docs).alias("by_id"),
        F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - BITS).alias("_tie"),
    )


def _key(dimension: str) -> Column:
    """Order along a dimension; equal values are ordered by the hash of id and text."""
    return F.shiftleft(F.col(dimension), BITS) + F.col("_tie")


def _choose(column: Column, cases: dict[int, Column], default: Column) -> Column:
    return reduce(lambda out, c: out.when(column == c[0], c[1]), cases.items(), F).otherwise(default) if cases else default


def _medians(table: DataFrame, nodes: list[Node], total: dict[int, int], slack: float) -> None:
    """Set ``split`` of each node: the key below which its left share of the bytes lies.

    Each pass cuts every node's key range into 4096 bins and sums the bytes of
    the bins in Spark; the bin with the wanted share becomes the next range.
    At most 4096 sums per node reach the driver, whatever the table's size.
    """
    key = _choose(F.col("_node"), {n.number: _key(DIMENSIONS[n.dimension]) for n in nodes}, F.lit(None).cast("long"))
    keyed = table.select("size", "_node", key.alias("_key")).where("_key IS NOT NULL")
    low = {n.number: 0 for n in nodes}
    below = {n.number: 0 for n in nodes}
    todo = {n.number: n for n in nodes}
    shift = 2 * BITS
    while todo and shift > 0:
        wide, shift = shift, max(0, shift - STEP)
        start = _choose(F.col("_node"), {k: F.lit(low[k]) for k in todo}, F.lit(None).cast("long"))
        offset = F.col("_key") - start
        bins = (
            keyed.where((offset >= 0) & (offset < F.lit(1 << wide)))
            .groupBy("_node", F.shiftright(offset, shift).alias("_bin")).agg(F.sum("size").alias("_bytes")).collect()
        )
        of: dict[int, list[tuple[int, int]]] = {k: [] for k in todo}
        for row in bins:
            of[row["_node"]].append((row["_bin"], row["_bytes"]))
        for k, n in list(todo.items()):
            wanted = total[k] * (n.shards // 2) / n.shards
            done = below[k]
            for place, size in sorted(of[k]):
                if done + size >= wanted:
                    break
                done += size
            else:
                place, size = 0, 0
            base = low[k] + (place << shift)
            if shift == 0 or size <= slack:
                before_is_nearer = wanted - done <= done + size - wanted
                n.split = base if before_is_nearer else base + (1 << shift)
                del todo[k]
            else:
                low[k], below[k] = base, done


def kd_tree(table: DataFrame, shards: int) -> DataFrame:
    """``table`` with the shard of each row; every level of the tree is written once."""
    span = table.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in DIMENSIONS for f in (F.min, F.max)]).first()
    extent = [max((span[f"max_{c}"] or 0) - (span[f"min_{c}"] or 0), 1) for c in DIMENSIONS]
    table = table.withColumn("_node", F.lit(0))
    nodes, count = [Node(0, 0, shards)], 1
    while any(n.shards > 1 for n in nodes):
        split = [n for n in nodes if n.shards > 1]
        stats = {
            r["_node"]: r
            for r in table.groupBy("_node").agg(
                F.sum("size").alias("_bytes"), *[(F.max(c) - F.min(c)).alias(c) for c in DIMENSIONS]
            ).collect()
        }
        total = {n.number: int(stats[n.number]["_bytes"]) if n.number in stats else 0 for n in split}
        for n in split:
            if n.number in stats:
                width = [stats[n.number][c] / extent[i] for i, c in enumerate(DIMENSIONS)]
                n.dimension = max(range(len(width)), key=lambda i: width[i])
        _medians(table, split, total, slack=sum(total.values()) / shards / 2000)
        below, cases = [n for n in nodes if n.shards == 1], {}
        for n in split:
            left, right = Node(count, n.first, n.shards // 2), Node(count + 1, n.first + n.shards // 2, n.shards - n.shards // 2)
            count += 2
            below += [left, right]
            cases[n.number] = F.when(_key(DIMENSIONS[n.dimension]) < n.split, left.number).otherwise(right.number)
        table = materialize(table.withColumn("_node", _choose(F.col("_node"), cases, F.col("_node"))), "kd-level")
        nodes = below
    shard = _choose(F.col("_node"), {n.number: F.lit(n.first) for n in nodes}, F.lit(0))
    return table.withColumn("shard", shard.cast("int"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Shard and place of each document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Boxes are split at the weighted median of their bytes along the dimension
    (text size, language, source, id) in which they are widest compared with
    the whole table, until each is one shard: ``shards`` of them, or as many as
    bring a shard to ``target_bytes``. Equal values are divided by a hash, so a
    source that holds a third of all rows is split like any other. ``slot``
    counts the rows of a shard without gaps, in blocks.

    Null texts have size 8; null languages, sources and ids have a place of
    their own. Repeated rows are placed each for itself. An empty table gives
    no rows; further columns are ignored.
    """
    table = materialize(_positions(docs).withColumn("_row", F.monotonically_increasing_id()), "kd-positions")
    if shards is None:
        total = table.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // (target_bytes or 1 << 30)))
    dealt = kd_tree(table, shards).select("doc_id", "size", "text_crc32", "_row", "shard")
    placed = running_total(dealt, ["shard"], "_row", {"slot": F.lit(1).cast("long")}, levels=2)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
