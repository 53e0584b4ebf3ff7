"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.text import word_count
from docloom.session import materialize

# A probability this close to 0 or 1 counts as integral.
TINY = 1e-9


def _pairs(p: np.ndarray, size: np.ndarray, live: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Settle pairs of ``live`` until at most one is left; which one it is."""
    while len(live) > 1:
        a, b = live[0 : len(live) - 1 : 2], live[1::2]
        pa, pb, sa, sb = p[a], p[b], size[a], size[b]
        up = np.minimum((1 - pa) * sa, pb * sb)
        down = np.minimum(pa * sa, (1 - pb) * sb)
        move = np.where(draw.random(len(a)) * (up + down) < down, up, -down)
        p[a], p[b] = pa + move / sa, pb - move / sb
        p[live] = np.where(p[live] < TINY, 0.0, np.where(p[live] > 1 - TINY, 1.0, p[live]))
        live = live[(p[live] > 0) & (p[live] < 1)]
    return live


def pivotal(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Round probabilities until at most one of them is fractional.

    Pairs of documents move words (probability times size) from one to the
    other until one is 0 or 1; the direction is drawn so that expectations
    stay, and the words of a pair stay exactly. Large documents come first:
    what is left of a size class is drawn, and the words that this adds or
    takes are taken from or given to all smaller documents alike, so that the
    one fractional document at the end is a small one.
    """
    p = np.where(p > 1 - TINY, 1.0, np.where(p < TINY, 0.0, p))
    rest = np.flatnonzero((p > 0) & (p < 1) & (size > 0))
    level = np.floor(np.log2(size, where=size > 0, out=np.zeros(len(size))))
    carried = rest[:0]
    for k in np.unique(level[rest])[::-1]:
        now = rest[level[rest] == k]
        rest = rest[level[rest] < k]
        carried = _pairs(p, size, np.concatenate([carried, now]), draw)
        if not len(carried) or not len(rest):
            continue
        i, words = carried[0], size[rest].sum()
        chosen = float(draw.random() < p[i])
        moved = p[rest] - (chosen - p[i]) * size[i] / words
        if moved.min() > TINY and moved.max() < 1 - TINY:
            p[rest], p[i] = moved, chosen
            carried = carried[:0]
    return p


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``target`` of each source (one row each, with ``source_size``).

    Weights go round over the sources by code point, null last. A target is
    the smaller of ``most`` times the size and the weight times a common
    level; the level is raised until the targets add up. Only sums go to the
    driver.
    """
    rank = F.row_number().over(Window.orderBy(F.col("no_source"), F.col("source_key"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    table = materialize(sizes.withColumn("weight", weight), "mix-sources")
    cap = F.col("source_size") * F.lit(most)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        full = cap < F.col("weight") * F.lit(level)
        fixed, rest = table.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        higher = (share * total - (fixed or 0.0)) / rest if rest else level
        if higher <= level:
            return table.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))
        level = higher


def mixture(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    block: int = 8192,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """How often the mix takes each document: ``keep``, size, source_size, target, copies, taken.

    A document's size is its number of words. Each source gets a target
    number of words (``source_targets``); its documents get the same expected
    number of copies, whose fraction is settled by pivotal rounding. Blocks of
    about ``block`` documents of a source leave one fractional document each;
    those meet in blocks of blocks, level by level, so a hot source is many
    tasks and a source's words differ from its target by less than one
    document. Blocks and draws are functions of ids and texts: reruns agree.

    Null and empty texts have size 0 and take nothing. A null source is a
    source of its own. Repeated rows are rounded each for itself. An empty
    table gives no rows; further columns are ignored.
    """
    table = docs.select(
        *keep,
        word_count(F.col("text")).alias("size"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        F.isnull("source").alias("no_source"),
        F.xxhash64("doc_id", "text").alias("_mark"),
    )
    table = materialize(table, "mix-sizes")
    key = ["source_key", "no_source"]
    sizes = table.groupBy(*key).agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    targets = source_targets(sizes, weights, share, most)
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(factor + TINY)
    table = table.join(targets.select(*key, "source_size", "target", "_docs"), key).select(
        *keep, *key, "size", "source_size", "target", "_mark",
        whole.cast("int").alias("_whole"),
        F.greatest(factor - whole, F.lit(0.0)).alias("_p"),
        F.pmod(F.xxhash64("_mark", F.lit(seed)), F.ceil(F.col("_docs") / block)).alias("_block"),
    )
    schema = table.schema

    def settle(level: int):
        def run(key, group):
            import pyarrow as pa

            group = group.sort_by([("_mark", "ascending"), ("size", "ascending")])
            draw = np.random.default_rng([seed, level, zlib.crc32(repr([k.as_py() for k in key]).encode())])
            p = pivotal(group.column("_p").to_numpy(), group.column("size").to_numpy().astype(float), draw)
            return group.set_column(group.schema.get_field_index("_p"), "_p", pa.array(p))

        return run

    done, level = None, 0
    fractional = (F.col("_p") > 0) & (F.col("_p") < 1) & (F.col("size") > 0)
    while True:
        settled = table.groupBy(*key, "_block").applyInArrow(settle(level), schema)
        settled = materialize(settled, "mix-level")
        left = settled.where(fractional)
        part = settled.where(~fractional)
        done = part if done is None else done.unionByName(part)
        most_left = left.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most_left <= 1:
            break
        table = left.withColumn("_block", F.floor(F.col("_block") / block))
        level += 1
    luck = F.pmod(F.xxhash64("_mark", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    last = left.withColumn("_p", F.when(luck < F.col("_p"), 1.0).otherwise(0.0))
    copies = F.col("_whole") + F.when((F.col("_p") >= 1) & (F.col("size") > 0), 1).otherwise(0)
    return done.unionByName(last).select(
        *keep, "size", "source_size", "target", copies.cast("int").alias("copies"),
        (F.col("size") * copies).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them; same columns."""
    numbered = docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row"))
    numbered = materialize(numbered, "mix-documents")
    plain = numbered.select("_row", "_doc.doc_id", "_doc.text", "_doc.source")
    plan = mixture(plain, keep=("_row",), **parameters).where("copies > 0").select("_row", "copies")
    repeated = numbered.join(plan, "_row").select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("_doc.*")
