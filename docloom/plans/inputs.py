"""Inputs derived from the given tables.

Every rule is a plain expression over whole tables, so SQL can restate it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import numbered_rows
from ..operators.running import running_total
from ..session import materialize, spread



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over the cores for chunking and embedding."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


# Indices into the title markers followed by the four tags-only markers.
META_MARKERS = fixed.TITLE_MARKERS + [m for m in fixed.TAGS_MARKERS if m not in fixed.TITLE_MARKERS]
META_FAMILIES = {
    0: [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    1: [0, 4, 5, 6, 8, 9, 10, 11, 12, 13],
    2: [0, 4, 5, 6, 8],
}


def meta_text(conv_id: Column, turn: Column, text: Column) -> Column:
    """The message behind the markers of the conversation's family, some left out."""
    shift = F.floor(conv_id / 4) + turn

    def marker(j: int) -> Column:
        families = [f for f, members in META_FAMILIES.items() if j in members]
        shown = (conv_id % 4).isin(families) & ((shift + j) % 5 != 0)
        return F.when(shown, META_MARKERS[j])

    return F.concat_ws(" ", *[marker(j) for j in range(len(META_MARKERS))], text)


def meta_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, content``: one prompt per user turn."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select(
        "conv_id", "turn", meta_text(F.col("conv_id"), F.col("turn"), F.col("text")).alias("content")
    )


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, asks, role, content``: conversations with varied roles and texts.

    ``asks`` marks the turns at which the client sends a request. Variations:
    meta prompts, suspicious words, short and blank texts, upper-case roles
    and turns sent by a tool.
    """
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    asks = F.col("role") == "user"
    content = (
        F.when(asks & ((conv + turn) % 5 == 0), meta_text(conv, turn, text))
        .when(asks & ((conv + turn) % 5 == 1), F.concat(text, F.lit(" Etage")))
        .when(asks & ((conv * 3 + turn) % 23 == 2), F.lit("ok"))
        .when(asks & ((conv * 3 + turn) % 23 == 3), F.lit("\t \n"))
        .otherwise(text)
    )
    role = (
        F.when(asks & (conv % 17 == 4), F.lit("tool"))
        .when(conv % 3 == 0, F.upper("role"))
        .otherwise(F.col("role"))
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", asks.alias("asks"), role.alias("role"), content.alias("content")
    )


def numbered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat log with ``question``, the number of questions up to each turn (counted in blocks)."""
    return running_total(
        chat_log(spark, sf_dir), ["conv_id"], "turn", {"question": F.col("asks").cast("long")}
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per question, and one for the turns that no question follows.

    Request ``r`` of a conversation holds the turns after question ``r - 2`` up
    to question ``r``, so every turn is in a request and each text is copied at
    most twice, however long the conversation is. The turns after the last
    question form a closing request of their own, without a user message. The
    answer of a request is the assistant turn that directly follows its question.
    """
    log = materialize(numbered_log(spark, sf_dir), "chat-log")
    replies = log.where(F.lower("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("answer")
    )
    asked = log.where("asks").select("conv_id", "turn", F.col("question").alias("req_no"))
    answers = asked.join(replies, ["conv_id", "turn"]).select("conv_id", "req_no", "answer")
    first = F.when(F.col("asks"), F.col("question")).otherwise(F.col("question") + 1)
    sent = log.withColumn("req_no", F.explode(F.sequence(first, first + 1)))
    own = F.col("req_no") == F.col("question")
    after = ~F.col("asks") & (F.col("req_no") == F.col("question") + 1)
    message = F.struct("turn", "role", "content")
    grouped = sent.groupBy("conv_id", "req_no").agg(
        F.array_sort(F.collect_list(message)).alias("all"),
        F.array_sort(F.collect_list(F.when(after, message))).alias("rest"),
        F.max(F.col("asks") & own).alias("asked"),
    )
    grouped = grouped.where(F.col("asked") | (F.size("rest") > 0)).withColumn(
        "m", F.when(F.col("asked"), F.col("all")).otherwise(F.col("rest"))
    )
    grouped = grouped.join(answers, ["conv_id", "req_no"], "left")
    conv, text_id = F.col("conv_id"), F.col("conv_id").cast("string")
    given = conv % 4 != 1
    return grouped.select(
        F.concat_ws("-", "conv_id", "req_no").alias("request_id"),
        "conv_id",
        F.when(conv % 10 == 9, None).when(conv % 10 == 8, "").otherwise(text_id).alias("chat_id"),
        "req_no",
        F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias(
            "messages"
        ),
        F.when(given, F.lit("modell-a")).alias("model"),
        F.when(given, F.lit(0.2)).alias("temperature"),
        F.when(given, F.lit(256)).alias("max_tokens"),
        "answer",
    )


def ollama_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests in the adapter's shape; some carry a prompt or nothing at all."""
    conv = F.col("conv_id")
    last = F.try_element_at("messages", F.lit(-1))["content"]
    return requests(spark, sf_dir).select(
        "request_id",
        "req_no",
        "conv_id",
        "model",
        F.when((conv % 5 == 0) & (conv % 25 != 0), last).alias("prompt"),
        F.when(conv % 5 != 0, F.col("messages")).alias("messages"),
        F.when(conv % 2 == 0, F.col("temperature")).alias("temperature"),
        "max_tokens",
        (conv % 3 == 0).alias("stream"),
        F.create_map(F.lit("temperature"), F.lit("0.4")).alias("options"),
        "answer",
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One element per line of a document; some without a page or a type."""
    return document_elements(table(spark, sf_dir, "documents"))


def document_elements(docs: DataFrame) -> DataFrame:
    lines = numbered_rows(docs, ["doc_id", "source"], F.split("text", "\n"), "elem_idx", "text")
    directory = F.concat(F.lit("./PDFs/"), F.col("source"))
    filename = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".pdf"))
    i = F.col("elem_idx")
    return lines.select(
        F.concat_ws("/", directory, filename).alias("file_path"),
        directory.alias("file_directory"),
        filename.alias("filename"),
        "elem_idx",
        F.when(i % 7 == 6, None).when(i == 0, "Title").otherwise("NarrativeText").alias("type"),
        "text",
        F.when((F.col("doc_id") + i) % 11 != 0, (1 + F.floor(i / 5)).cast("int")).alias("page_number"),
    )


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, modificationTime, length``: the pages as files, base names clashing."""
    stem = F.regexp_extract("url", r"^https?://([^?#]*?)/?(?:[?#].*)?$", 1)
    return table(spark, sf_dir, "pages").select(
        F.concat(
            stem, F.when(F.col("page_id") % 9 == 4, F.lit(".PDF")).otherwise(F.lit(".pdf"))
        ).alias("path"),
        F.timestamp_seconds(1700000000 + (F.col("page_id") % 7) * 86400).alias("modificationTime"),
        F.octet_length("html").cast("long").alias("length"),
    )


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_path, content``: some contents missing or empty."""
    page = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages/"), page, F.lit(".html")).alias("file_path"),
        F.when(page % 10 == 3, None).when(page % 10 == 5, "").otherwise(F.col("html")).alias("content"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as index nodes; some without a file name or a page."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("n"), F.lpad(v.cast("string"), 6, "0")).alias("node_id"),
        F.concat(F.lit("passage "), v, F.lit("\nlabel "), F.col("label")).alias("text"),
        F.when(v % 53 != 0, F.concat(F.lit("doc_"), v % 37, F.lit(".pdf"))).alias("filename"),
        F.when(v % 29 != 0, (1 + v % 12).cast("int")).alias("page_number"),
        "embedding",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a question."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, value``: the events as lines of a log file."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat_ws(" - ", stamp, level, F.concat(F.lit("  "), "event_type", F.lit("  "))).alias("value")
    )


