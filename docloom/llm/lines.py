"""Cross-document line frequency as a quality rule (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import let
from docloom.llm.text import GAP, WORD_CHAR, hash60, with_text, words
from docloom.session import materialize

WINDOW = 5


def _repeat_words(grams: Column) -> Column:
    """Words inside windows that occur at least twice; ``grams`` in text order."""
    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def places(sorted_pairs: Column) -> Column:
        n = F.size(sorted_pairs)
        same = lambda x, k: F.when(
            (k >= 0) & (k < n), F.get(sorted_pairs, k)["g"] == x["g"]
        ).otherwise(False)
        hit = F.filter(sorted_pairs, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        step = F.transform(
            at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), p + WINDOW) - p)
        )
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(pairs, places), covered)


def text_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the word, symbol and line figures of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda x: F.regexp_like(x, F.lit(WORD_CHAR))
    stage = docs.select(
        *keep,
        words(F.col("text")).alias("_w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), has_word).alias("_lines"),
    )
    gram = lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(WINDOW)])
    grams = F.when(
        F.size("_w") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), gram),
    ).otherwise(F.array().cast("array<long>"))
    norm = F.transform("_lines", lambda x: F.trim(F.regexp_replace(F.lower(x), GAP, " ")))
    stage = stage.select(
        *keep,
        "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("_grams"),
        norm.alias("_norm"),
    )
    repeated = F.size(F.array_distinct("_grams")) < F.size("_grams")
    return stage.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(repeated, _repeat_words(F.col("_grams"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("_norm", hash60).alias("line_hash"),
        F.transform("_norm", lambda x: F.size(F.split(x, " "))).alias("line_words"),
    )


def _judged(docs: DataFrame, max_docs: int, max_share: float, min_words: int) -> DataFrame:
    """One row per document with its figures, the hashes of its removed lines and the verdict."""
    table = docs.select(
        "doc_id", F.coalesce(F.col("source"), F.lit("")).alias("host"), F.isnull("source").alias("no_host"), "text"
    ).withColumn("_row", F.monotonically_increasing_id())
    base = materialize(text_features(table, ["_row", "doc_id", "host", "no_host"]), "line-features")
    host = ["host", "no_host"]

    # Documents with one set of lines count once, so copies don't make their own lines frequent.
    lines = base.select(
        "_row", *host, F.xxhash64(F.array_sort(F.array_distinct("line_hash"))).alias("_set"),
        F.explode(F.array_distinct("line_hash")).alias("line"),
    )
    sizes = base.groupBy(*host).agg(F.count("*").alias("_docs")).withColumn(
        "_limit", F.greatest(F.lit(float(max_docs)), F.col("_docs") * F.lit(max_share))
    )
    often = lines.groupBy(*host, "line").agg(F.count("*").alias("_n")).where(F.col("_n") > max_docs)
    often = often.join(sizes, host).where(F.col("_n") > F.col("_limit")).select(*host, "line", "_limit")
    hits = materialize(lines.join(often, [*host, "line"]), "line-hits")
    frequent = (
        hits.select(*host, "line", "_limit", "_set").distinct()
        .groupBy(*host, "line", "_limit").agg(F.count("*").alias("_sets"))
        .where(F.col("_sets") > F.col("_limit")).select(*host, "line")
    )
    removed = (
        hits.select("_row", *host, "line").join(frequent, [*host, "line"])
        .groupBy("_row").agg(F.collect_set("line").alias("_gone"))
    )
    gone = F.filter(
        F.arrays_zip("line_hash", "line_words"), lambda x: F.array_contains("_gone", x["line_hash"])
    )
    out = base.join(removed, "_row", "left").withColumn(
        "_cut", F.coalesce(gone, F.array().cast("array<struct<line_hash:long,line_words:int>>"))
    )
    lost = F.aggregate("_cut", F.lit(0).cast("long"), lambda a, x: a + x["line_words"])
    return out.select(
        "_row", "doc_id", *host, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_gone",
        F.size("_cut").cast("long").alias("n_removed_lines"), lost.alias("n_removed_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    ).withColumn(
        "kept",
        ~F.col("base_failed")
        & (2 * F.col("n_removed_words") <= F.col("n_words"))
        & (F.col("n_words") - F.col("n_removed_words") >= min_words),
    )


def line_quality(
    docs: DataFrame, max_docs: int = 15, max_share: float = 0.01, min_words: int = 10
) -> DataFrame:
    """Word and line figures of each document and the verdict of the line-frequency rule.

    A line is normalised (lower case, single spaces), hashed, and counted once
    per document of its host (``source``). It is above the limits, and goes,
    when more than ``max_docs`` distinct documents of the host and more than
    ``max_share`` of its rows have it. Documents are distinct when their sets
    of lines are, so copies count once.
    A document is rejected when the base rules fail, when more than half of
    its words were in removed lines, or when fewer than ``min_words`` are left.

    Null and empty texts have no words and fail the base rules. A null source
    is a host of its own. Rows with a repeated or null id are judged each for
    itself. An empty table gives no rows; further columns are ignored.
    """
    return _judged(docs, max_docs, max_share, min_words).drop("_row", "host", "no_host", "_gone")


def keep_documents(
    docs: DataFrame, max_docs: int = 15, max_share: float = 0.01, min_words: int = 10
) -> DataFrame:
    """The documents that pass, without their removed lines; same columns, ``n_chars`` recounted.

    Null and empty texts go, as the base rules fail. Rows that agree on text
    and source share one verdict, so repeated rows and ties all stay or all
    go; a null source is a host of its own. An empty table stays empty.
    Columns of any name travel along and can't clash with inner ones.
    """
    # The verdict is a function of text and host, so these are the key; the texts are not written.
    key = ["_mark", "host", "no_host"]
    host = [F.coalesce("source", F.lit("")).alias("host"), F.isnull("source").alias("no_host")]
    mark = F.md5(F.coalesce("text", F.lit("")))
    plain = docs.select(mark.alias("doc_id"), "text", "source")
    verdict = _judged(plain, max_docs, max_share, min_words).where("kept").withColumnRenamed("doc_id", "_mark")
    verdict = verdict.select(*key, "_gone").dropDuplicates(key)
    packed = docs.select(F.struct("*").alias("_doc"), mark.alias("_mark"), *host)
    norm = lambda x: hash60(F.trim(F.regexp_replace(F.lower(x), GAP, " ")))
    left = F.array_join(
        F.filter(F.split("_doc.text", "\n"), lambda x: ~F.array_contains("_gone", norm(x))), "\n"
    )
    text = F.when(F.col("_gone").isNull(), F.col("_doc.text")).otherwise(left)
    return with_text(packed.join(verdict, key).select("_doc", text.alias("_left")), docs.columns)
