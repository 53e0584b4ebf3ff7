"""Element sources: extractor JSON, HTML by expression, and pluggable extractors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import numbered_rows, strip
from ..operators.elements import normalize

# One file's content and a strategy in, its (type, text, page) elements out.
Extractor = Callable[..., Iterable[tuple[str | None, str | None, int | None]]]

# Element types of the HTML tags.
HTML_TYPES = {"h1": "Title", "p": "NarrativeText", "li": "ListItem"}

# Rows handed back to Spark at once.
OUT_ROWS = 10_000

EXTRACTED = (
    "file_path string, elem_idx int, type string, text string, page_number int, "
    "status string, error string, strategy_used string, seconds double"
)


def read_element_json(spark: SparkSession, path: str) -> DataFrame:
    """Files holding one JSON array of elements each; ``elem_idx`` is the place in the array."""
    raw = spark.read.text(path, wholetext=True)
    return parse_element_json(raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("json")))


def parse_element_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Element rows from a column with a JSON array per file (``file_path``)."""
    parsed = F.from_json(F.col(column), "array<struct<text string, type string, metadata struct<page_number int>>>")
    return normalize(
        numbered_rows(df, ["file_path"], parsed, "elem_idx", "e").select(
            "file_path", "elem_idx", "e.text", "e.type", F.col("e.metadata.page_number").alias("page_number")
        )
    )


def html_tags(html: Column, tags: Iterable[str] = HTML_TYPES) -> Column:
    """The markup of every element with one of the tags, in page order."""
    names = "|".join(tags)
    return F.regexp_extract_all(html, F.lit(rf"(?s)<(?:{names})(?:\s[^>]*)?>.*?</(?:{names})>"), F.lit(0))


def html_type(markup: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in HTML_TYPES.items() for x in pair])
    return F.try_element_at(kinds, F.regexp_extract(markup, r"^<(\w+)", 1))


def html_text(markup: Column) -> Column:
    return strip(F.regexp_replace(markup, "<[^>]+>", " "))


def html_elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row per h1, p or li element of a page."""
    return numbered_rows(pages, [key], html_tags(F.col(html)), "elem_idx", "m").select(
        key, "elem_idx", html_type(F.col("m")).alias("type"), html_text(F.col("m")).alias("text")
    )


def with_fallback(primary: Column, fallback: Column, names: tuple[str, str]) -> tuple[Column, Column]:
    """The primary extractor's elements, or the fallback's when there are none, and which was used."""
    has = F.size(primary) > 0
    return F.when(has, primary).otherwise(fallback), F.when(has, names[0]).otherwise(names[1])


def extract(files: DataFrame, extractor: Extractor | list[tuple[str, Extractor]], strategy: str = "auto") -> DataFrame:
    """Run extractors on every ``file_path, content`` row.

    ``extractor`` is one, called as ``extractor(content, strategy=...)`` and
    once more without a strategy on any ``TypeError``, or a chain of named
    ones: the next is asked when one fails or finds nothing. ``strategy_used``
    names the strategy or the extractor that found the elements, ``seconds``
    the time the file took. A file that fails or yields nothing stays in the
    result as one row with its status, so one bad file stops nothing.
    """
    chain = extractor if isinstance(extractor, list) else [(None, extractor)]

    def ask(name, function, content) -> tuple[list, str]:
        try:
            return list(function(content, strategy=strategy)), name or strategy
        except TypeError:
            return list(function(content)), name or "default"

    def one(content) -> tuple[list, str | None, str | None]:
        error, used = None, None
        for name, function in chain:
            try:
                found, used = ask(name, function, content)
            except Exception as problem:  # noqa: BLE001 - any failure is the file's status
                error = type(problem).__name__
                continue
            error = None
            if found:
                return found, used, None
        return [], used, error

    def rows(path, content) -> Iterator[tuple]:
        started = time.perf_counter()
        found, used, error = one(content)
        took = time.perf_counter() - started
        if not found:
            yield path, None, None, None, None, "failed" if error else "empty", error, None if error else used, took
        for i, (kind, text, page) in enumerate(found):
            yield path, i, kind, text, page, "loaded", None, used, took

    names = [f.strip().split(" ")[0] for f in EXTRACTED.split(",")]

    def frame(buffer: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(buffer, columns=names, dtype=object)
        return out.astype({"elem_idx": "Int32", "page_number": "Int32", "seconds": float})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch["file_path"], batch["content"]):
                for row in rows(path, content):
                    buffer.append(row)
                    if len(buffer) == OUT_ROWS:
                        yield frame(buffer)
                        buffer = []
        if buffer:
            yield frame(buffer)

    return files.select("file_path", "content").mapInPandas(run, EXTRACTED)


def loaded_elements(extracted: DataFrame) -> DataFrame:
    return normalize(
        extracted.where(F.col("status") == "loaded").drop("status", "error", "strategy_used", "seconds")
    )


def extract_status(extracted: DataFrame) -> DataFrame:
    """Files, elements and seconds per outcome and error class."""
    per_file = extracted.groupBy("file_path", "status", "error").agg(
        F.count("elem_idx").alias("n_elements"), F.max("seconds").alias("seconds")
    )
    return per_file.groupBy("status", "error").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_elements").alias("n_elements"), F.sum("seconds").alias("seconds")
    )
