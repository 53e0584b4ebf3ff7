"""Message classes over a stream: the same columns as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import is_flagged, is_suspicious, with_verdict


def classify(messages: DataFrame, text: str = "content") -> DataFrame:
    """Add ``is_meta, meta_type, confidence, suspicious, flagged``; works on streams and tables."""
    return (
        with_verdict(messages, text)
        .select(
            *messages.columns,
            "meta.is_meta",
            F.col("meta.type").alias("meta_type"),
            "meta.confidence",
            is_suspicious(F.col(text)).alias("suspicious"),
            is_flagged(F.col(text)).alias("flagged"),
        )
    )
