"""The licence classifier is fitted on every line of every document."""

from pyspark.sql import functions as F

from docloom.llm import licenses as L


def _lines(spark, docs):
    words = L._vocabulary(spark)
    lines, templates = L.paragraphs(docs, words), L._templates(spark, words)
    return L.training_rows(lines, L.notice_rows(docs, words, templates), templates), words


def test_all_lines_are_counted(spark, make_docs):
    """More than 300 documents, lines beyond the 20th, repeated lines once, near notices and blank lines not at all."""
    text = lambda i: "\n".join([*(f"line {chr(97 + j)} of text w{chr(97 + i % 26)}x{chr(97 + i // 26)}" for j in range(25)), "", "the same line", L.TEMPLATES["mit"][0]])
    docs = make_docs([(i, text(i), "en", "a") for i in range(400)] + [(None, None, None, None)])
    rows, _ = _lines(spark, docs)
    plain = rows.where(F.col("class") == L.NONE)
    assert plain.agg(F.sum("n")).first()[0] == 400 * 25 + 1
    assert 0 < plain.where("held").agg(F.sum("n")).first()[0] < 400 * 25 / 2


def test_numbers_are_those_of_the_words(spark, make_docs):
    words = L._vocabulary(spark)
    row = L.paragraphs(make_docs([(1, "Released under the MIT License.", "en", "a")]), words).first()
    assert sorted(words[i] for i in row.known) == sorted(["released", "under", "the", "mit", "license", "released under", "under the", "the mit", "mit license"])
