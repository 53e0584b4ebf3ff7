import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, _t string, size string, shard string, copies string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text, lang, source) rows as a table with further columns whose names clash with inner ones."""

    def make(rows):
        full = [(i, t, lang, s, None if t is None else len(t), "x", "x", "x", "x", "x") for i, t, lang, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long_text = " ".join(f"word{i % 997}x{i // 997}" for i in range(30_000))
    return [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a"),
        (1, "one two three four five six seven eight nine ten eleven", "en", "a"),
        (2, "one two three four five six seven eight nine ten eleven", "en", None),
        (3, None, "en", "a"),
        (4, "", "de", "b"),
        (5, " \t\n ", None, "b"),
        (6, "short", "de", None),
        (7, long_text, "en", "a"),
        (None, "a row without an id but with some words in its text", "en", "b"),
        (None, None, None, None),
        (8, "Ünïcödé wörds – und 漢字 mit Zeichen 😀 und noch mehr Wörter hier", "de", "c"),
        (9, "<|endoftext|> # * $ % & | < > 12345 -- 67890", None, "c"),
    ]


@pytest.fixture(scope="session")
def odd(make_docs, odd_rows):
    return make_docs(odd_rows)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])
