"""Hits, citations, cited answers, context and prompts.

An answer has at most k hits, so everything per query is a small group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import one_line, preview_always
from .sieve import sieve


def hits_with_metadata(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Inner equi-join on the node id; the vectors are not read again.

    ``hits`` is read several times, so pass a written frame, not a search still to
    be run. The nodes are first reduced to those that were hit, with each id once on
    both sides; a sketch of the ids keeps most others, and their texts, from being
    moved for that. A passage found by very many queries makes a large partition
    of short rows, which adaptive execution splits; nothing is copied for the
    others.
    """
    kept = [c for c in nodes.columns if c != "embedding"]
    asked = hits.select(F.col("node_id").alias("id"))
    found = sieve(nodes.select(*kept), "node_id", asked).join(hits.select("node_id").distinct(), "node_id", "left_semi")
    return hits.join(found, "node_id")


def page_text(page: Column) -> Column:
    return F.coalesce(page.cast("string"), F.lit(fixed.NO_PAGE))


def citation(filename: Column, page: Column) -> Column:
    return F.concat(
        F.lit("(Quelle: "),
        F.coalesce(filename, F.lit(fixed.UNKNOWN_DOCUMENT)),
        F.lit(", Seite: "),
        page_text(page),
        F.lit(")"),
    )


def hit_previews(found: DataFrame) -> DataFrame:
    """One line per hit, with defaults for what is missing."""
    return found.withColumns(
        {
            "filename": F.coalesce("filename", F.lit(fixed.UNKNOWN_DOCUMENT)),
            "page": page_text(F.col("page_number")),
            "score": F.coalesce("score", F.lit(0.0)),
            "preview": preview_always(one_line(F.col("text")), 70),
        }
    )


def citations(found: DataFrame) -> DataFrame:
    """Per query: distinct citations in code point order, hit and citation counts,
    and the undeduplicated ``file:page`` list in hit order."""
    source = F.concat_ws(
        ":", F.coalesce("filename", F.lit(fixed.UNKNOWN_FILE)), page_text(F.col("page_number"))
    )
    per_query = found.groupBy("query_id").agg(
        F.array_sort(F.collect_set(citation(F.col("filename"), F.col("page_number")))).alias("citations"),
        F.count(F.lit(1)).alias("source_nodes_count"),
        F.array_sort(F.collect_list(F.struct("rank", source.alias("source")))).alias("_s"),
    )
    return per_query.withColumns(
        {
            "unique_sources_count": F.size("citations").cast("long"),
            "sources": F.array_join(F.col("_s.source"), ", "),
        }
    ).drop("_s")


def already_cited(answer: Column, cited: Column) -> Column:
    """True when any citation occurs in the answer, whatever the case."""
    lowered = F.lower(answer)
    return F.exists(cited, lambda c: F.contains(lowered, F.lower(c)))


def with_sources(answer: Column, cited: Column) -> Column:
    """The answer, with the source block when it names none of its sources."""
    block = F.concat(answer, F.lit(fixed.SOURCES_HEADING), F.array_join(cited, "\n"))
    return F.when((F.size(cited) > 0) & ~already_cited(answer, cited), block).otherwise(answer)


def context_text(found: DataFrame) -> DataFrame:
    """Per query: the numbered texts of its hits in rank order."""
    numbered = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "text"))),
        lambda h, i: F.concat(F.lit("\n\nDokument "), i + 1, F.lit(":\n"), h["text"]),
    )
    return found.groupBy("query_id").agg(F.array_join(numbered, "").alias("context"))


def prompt(context: Column, question: Column, system: str = fixed.SYSTEM_PROMPT) -> Column:
    return F.concat(
        F.lit(system + fixed.CONTEXT_HEADING),
        F.coalesce(context, F.lit("")),
        F.lit(fixed.QUESTION_HEADING),
        F.coalesce(question, F.lit("")),
        F.lit(fixed.ANSWER_CUE),
    )


def truncate_prompt(text: Column) -> Column:
    """The generator's input limit: a long prompt keeps its head and gets the answer cue."""
    cut = F.concat(F.substring(text, 1, fixed.PROMPT_KEEP), F.lit(fixed.ANSWER_CUE))
    return F.when(F.length(text) > fixed.PROMPT_LIMIT, cut).otherwise(text)
