"""Rule-based message classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .text import contains_any, count_contained, let


def _share(lowered: Column, markers: list[str]) -> Column:
    return count_contained(lowered, markers).cast("double") / F.lit(float(len(markers)))


def title_score(text: Column) -> Column:
    return _share(F.lower(text), fixed.TITLE_MARKERS)


def tags_score(text: Column) -> Column:
    return _share(F.lower(text), fixed.TAGS_MARKERS)


def general_score(text: Column) -> Column:
    return _share(F.lower(text), fixed.GENERAL_MARKERS)


def verdict(title: Column, tags: Column, general: Column) -> Column:
    """``struct<is_meta, type, confidence>`` from the three scores.

    The order of the tests matters: six markers are shared, so a tags prompt
    that carries all of them is a title request. A message that is not meta
    has confidence 0, not its score.
    """

    def outcome(is_meta: bool, kind: str | None, confidence: Column) -> Column:
        return F.struct(
            F.lit(is_meta).alias("is_meta"),
            F.lit(kind).cast("string").alias("type"),
            confidence.alias("confidence"),
        )

    return (
        F.when(title >= fixed.TYPED_THRESHOLD, outcome(True, "title", title))
        .when(tags >= fixed.TYPED_THRESHOLD, outcome(True, "tags", tags))
        .when(general >= fixed.GENERAL_THRESHOLD, outcome(True, "unknown", general))
        .otherwise(outcome(False, None, F.lit(0.0)))
    )


def meta_verdict(text: Column) -> Column:
    """The verdict as a single expression, for use inside other expressions."""

    def scores(lowered: Column) -> Column:
        return F.struct(
            _share(lowered, fixed.TITLE_MARKERS).alias("title"),
            _share(lowered, fixed.TAGS_MARKERS).alias("tags"),
            _share(lowered, fixed.GENERAL_MARKERS).alias("general"),
        )

    found = let(F.lower(text), scores)
    return let(found, lambda s: verdict(s["title"], s["tags"], s["general"]))


def with_verdict(df: DataFrame, text: str) -> DataFrame:
    """Add column ``meta``; the scores are projected first so each is computed once."""
    scored = df.withColumns(
        {
            "_title": title_score(F.col(text)),
            "_tags": tags_score(F.col(text)),
            "_general": general_score(F.col(text)),
        }
    )
    meta = verdict(F.col("_title"), F.col("_tags"), F.col("_general"))
    return scored.withColumn("meta", meta).drop("_title", "_tags", "_general")


def is_suspicious(text: Column) -> Column:
    return contains_any(text, fixed.SUSPICIOUS_KEYWORDS)


def is_flagged(text: Column) -> Column:
    return contains_any(text, fixed.FLAG_KEYWORDS)


def meta_answer(meta_type: Column, answer: Column) -> Column:
    """The generated answer, or the canned text of the meta type when there is none."""
    canned = (
        F.when(meta_type == "title", fixed.META_FALLBACK_TITLE)
        .when(meta_type == "tags", fixed.META_FALLBACK_TAGS)
        .otherwise(fixed.META_FALLBACK_OTHER)
    )
    return F.coalesce(answer, canned)
