"""Overlapping and hierarchical chunks, links, children, statistics.

All spans of a document are integer arithmetic inside its row, and ids are
hashes of ``document|level|path``, so links and parents need no window and no
join: chunking is narrow whatever the document sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import let, numbered_rows, tokens

ChunkParser = Callable[[DataFrame], DataFrame]


def starts(n: Column, size: int, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """Start offsets of the windows over ``n`` tokens: one at 0 when they fit."""
    stride = size - overlap
    last = F.ceil(F.greatest(n - size, F.lit(0)) / stride).cast("int") * stride
    return F.sequence(F.lit(0), last, F.lit(stride))


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("n_tokens", F.size(tokens(F.col(text))))


def _text(toks: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(toks, start + 1, end - start), " ")


def chunk_fixed(
    docs: DataFrame, size: int, overlap: int = fixed.CHUNK_OVERLAP, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One sliding-window level: ``chunk_idx, tok_start, tok_end, text`` per window."""

    def windows(toks: Column) -> Column:
        n = F.size(toks)
        return F.transform(
            starts(n, size, overlap),
            lambda s: F.struct(
                s.alias("tok_start"),
                F.least(s + size, n).alias("tok_end"),
                _text(toks, s, F.least(s + size, n)).alias("text"),
            ),
        )

    rest = [c for c in docs.columns if c not in (doc_id, text)]
    cut = let(tokens(F.col(text)), windows)
    return numbered_rows(docs, [doc_id, *rest], cut, "chunk_idx", "c").select(doc_id, "chunk_idx", "c.tok_start", "c.tok_end", "c.text", *rest)


def _level_spans(n: Column, sizes: Sequence[int], overlap: int) -> Column:
    """``array<array<struct<start, end, path, parent>>>``: the spans of each level, in order.

    Built inside nested variables so that a level is computed once although
    both its own output and the next level use it.
    """

    def top(size: int) -> Column:
        return F.transform(
            starts(n, size, overlap),
            lambda s, i: F.struct(
                s.alias("start"),
                F.least(s + size, n).alias("end"),
                i.cast("string").alias("path"),
                F.lit(None).cast("string").alias("parent"),
            ),
        )

    def below(parents: Column, size: int) -> Column:
        def cut(p: Column) -> Column:
            return F.transform(
                starts(p["end"] - p["start"], size, overlap),
                lambda s, i: F.struct(
                    (p["start"] + s).alias("start"),
                    F.least(p["start"] + s + size, p["end"]).alias("end"),
                    F.concat_ws(".", p["path"], i.cast("string")).alias("path"),
                    p["path"].alias("parent"),
                ),
            )

        return F.flatten(F.transform(parents, cut))

    def rest(parents: Column, remaining: Sequence[int]) -> Column:
        own = F.array(parents)
        if not remaining:
            return own
        return F.concat(own, let(below(parents, remaining[0]), lambda lv: rest(lv, remaining[1:])))

    return let(top(sizes[0]), lambda lv: rest(lv, sizes[1:]))


def chunk_hierarchical(
    docs: DataFrame,
    sizes: Sequence[int] = fixed.CHUNK_SIZES,
    overlap: int = fixed.CHUNK_OVERLAP,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Nodes of all levels; each level cuts the chunks of the one above.

    Columns: ``node_id, doc_id, level, chunk_idx, tok_start, tok_end, text,
    parent_id, prev_id, next_id`` and the other input columns (metadata),
    which every node inherits.
    """

    def spans(toks: Column) -> Column:
        numbered = let(
            _level_spans(F.size(toks), sizes, overlap),
            lambda levels: F.flatten(
                F.transform(
                    levels,
                    lambda lv, level: F.transform(
                        lv,
                        lambda sp, i: F.struct(
                            level.alias("level"),
                            i.alias("chunk_idx"),
                            sp["start"].alias("tok_start"),
                            sp["end"].alias("tok_end"),
                            sp["path"].alias("path"),
                            sp["parent"].alias("parent"),
                            F.get(lv, i - 1)["path"].alias("prev"),
                            F.get(lv, i + 1)["path"].alias("next"),
                        ),
                    ),
                )
            ),
        )
        return F.transform(
            numbered,
            lambda sp: F.struct(sp.alias("sp"), _text(toks, sp["tok_start"], sp["tok_end"]).alias("text")),
        )

    def node(path: str, level: Column) -> Column:
        p = F.col(f"sp.{path}")
        key = F.concat_ws("|", F.col(doc_id).cast("string"), level.cast("string"), p)
        return F.when(p.isNotNull(), F.sha2(key, 256))

    rest = [c for c in docs.columns if c not in (doc_id, text)]
    level = F.col("sp.level")
    return docs.select(doc_id, *rest, F.inline(let(tokens(F.col(text)), spans))).select(
        node("path", level).alias("node_id"),
        doc_id,
        "sp.level",
        "sp.chunk_idx",
        "sp.tok_start",
        "sp.tok_end",
        "text",
        node("parent", level - 1).alias("parent_id"),
        node("prev", level).alias("prev_id"),
        node("next", level).alias("next_id"),
        *rest,
    )


def children(nodes: DataFrame) -> DataFrame:
    """The child ids of every node that has some, in chunk order.

    A chunk has few children (the sizes bound their number), so the lists
    are short.
    """
    return (
        nodes.where(F.col("parent_id").isNotNull())
        .groupBy("parent_id")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "node_id"))).alias("c"))
        .select(F.col("parent_id").alias("node_id"), F.col("c.node_id").alias("children"))
    )


def chunk_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("level").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.sum(F.length("text")).alias("total_chars"),
        F.max(F.length("text")).cast("long").alias("max_chars"),
    )


def leaves(nodes: DataFrame, level: int = len(fixed.CHUNK_SIZES) - 1) -> DataFrame:
    return nodes.where(F.col("level") == level)


def dedupe_texts(nodes: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One node per document and text: the first one of the highest level."""
    rest = [c for c in nodes.columns if c not in (doc_id, "text", "level", "chunk_idx")]
    first = F.min_by(F.struct(*rest), F.struct("level", "chunk_idx")).alias("n")
    at = F.min(F.struct("level", "chunk_idx")).alias("at")
    return (
        nodes.groupBy(doc_id, "text")
        .agg(at, first)
        .select(doc_id, "text", "at.level", "at.chunk_idx", *[F.col(f"n.{c}").alias(c) for c in rest])
    )


def hierarchical_parser(
    sizes: Sequence[int] = fixed.CHUNK_SIZES, overlap: int = fixed.CHUNK_OVERLAP
) -> ChunkParser:
    """The default chunk parser; pass another ``DataFrame -> DataFrame`` to replace it."""
    return lambda docs: chunk_hierarchical(docs, sizes, overlap)
