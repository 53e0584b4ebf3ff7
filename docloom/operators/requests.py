"""Chat requests: defaults, sessions, last user message, alternative question, outcome.

A request is one row with its messages nested, as it arrives, so everything
here is a narrow projection: no shuffle, and a request is never larger than
the record it came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.classify import is_flagged, meta_verdict
from ..functions.text import any_contained, let, numbered_rows, strip


def with_defaults(requests: DataFrame) -> DataFrame:
    return requests.withColumns(
        {
            "model": F.coalesce("model", F.lit(fixed.DEFAULT_MODEL)),
            "temperature": F.coalesce("temperature", F.lit(fixed.DEFAULT_TEMPERATURE)),
            "max_tokens": F.coalesce("max_tokens", F.lit(fixed.DEFAULT_MAX_TOKENS)),
        }
    )


def with_session(requests: DataFrame, random_ids: bool = False) -> DataFrame:
    """Keep a given chat id; an empty or missing one starts a session of its own.

    The new id is a hash of the request id, so a recomputed task assigns the
    same one; ``random_ids`` gives random UUIDs instead, which must then be
    written out before they are used twice.
    """
    fresh = F.uuid() if random_ids else F.sha2(F.col("request_id"), 256)
    return requests.withColumns(
        {
            "new_session": F.coalesce(F.col("chat_id") == "", F.lit(True)),
            "chat_id": F.coalesce(F.nullif(F.col("chat_id"), F.lit("")), fresh),
        }
    )


def is_user(role: Column) -> Column:
    return F.coalesce(F.lower(role) == "user", F.lit(False))


def normalize_role(role: Column) -> Column:
    """``user`` in any case stays user; everything else, also system and tool, is assistant."""
    return F.when(is_user(role), "user").otherwise("assistant")


def message_rows(requests: DataFrame) -> DataFrame:
    """One row per message with its 0-based position and its keyword flag."""
    keep = ["request_id", "chat_id", "req_no"]
    return numbered_rows(requests, keep, F.col("messages"), "pos", "message").select(
        "request_id",
        "chat_id",
        "req_no",
        "pos",
        F.col("message.role").alias("role"),
        F.col("message.content").alias("content"),
        is_flagged(F.col("message.content")).alias("flagged"),
    )


def user_texts(messages: Column) -> Column:
    """Texts of the user messages, in order."""
    return F.transform(F.filter(messages, lambda m: is_user(m["role"])), lambda m: m["content"])


def last_of(texts: Column) -> Column:
    return F.try_element_at(texts, F.lit(-1))


def _suspicious(text: Column) -> Column:
    """``is_suspicious`` inside a lambda: the text is lower-cased once, not once per keyword."""
    return let(F.lower(text), lambda lowered: any_contained(lowered, fixed.SUSPICIOUS_KEYWORDS))


def alternative(texts: Column) -> Column:
    """``struct<content, idx>`` of the newest user message that is long enough and clean.

    Used only when the last message is suspicious, which then cannot be its
    own alternative, so the last message needs no special exclusion.
    """
    numbered = F.transform(
        texts, lambda text, i: F.struct(text.alias("content"), (i + 1).alias("idx"))
    )
    usable = F.filter(
        numbered, lambda m: (F.length(m["content"]) > 10) & ~_suspicious(m["content"])
    )
    return last_of(usable)


def _choose(texts: Column, last: Column, meta: Column) -> Column:
    """The question, and whether and which earlier message it is."""

    def chosen(s: Column) -> Column:
        return F.struct(
            last.alias("last_user"),
            meta.alias("meta"),
            s["suspicious"].alias("suspicious"),
            s["alternative"].isNotNull().alias("alternative_used"),
            s["alternative"]["idx"].alias("alternative_idx"),
            F.coalesce(s["alternative"]["content"], last).alias("question"),
        )

    doubted = ~meta["is_meta"] & F.coalesce(_suspicious(last), F.lit(False))
    looked = let(
        doubted,
        lambda d: F.struct(d.alias("suspicious"), F.when(d, alternative(texts)).alias("alternative")),
    )
    return let(looked, chosen)


def resolution(messages: Column) -> Column:
    """One struct with everything that is decided about a request.

    The steps are bound as variables: whatever filter a caller puts on the
    result, Catalyst repeats the whole expression at most once, not every
    step for every use of it.
    """

    def checked(r: Column) -> Column:
        missing = r["last_user"].isNull()
        too_short = ~r["meta"]["is_meta"] & (F.length(strip(r["question"])) < 3)
        return F.when(missing, fixed.ERROR_NO_USER).when(too_short, fixed.ERROR_TOO_SHORT)

    def outcome(r: Column, detail: Column) -> Column:
        fields = ["last_user", "meta", "suspicious", "alternative_used", "alternative_idx", "question"]
        return F.struct(
            *[r[f].alias(f) for f in fields],
            detail.alias("detail"),
            F.when(detail.isNull(), 200).otherwise(500).alias("status_code"),
            F.when(detail.isNotNull(), "error")
            .when(r["meta"]["is_meta"], "meta")
            .otherwise("retrieval")
            .alias("route"),
        )

    decided = let(
        user_texts(messages),
        lambda texts: let(
            last_of(texts),
            lambda last: let(meta_verdict(last), lambda meta: _choose(texts, last, meta)),
        ),
    )
    return let(decided, lambda r: let(checked(r), lambda detail: outcome(r, detail)))


def resolve(requests: DataFrame) -> DataFrame:
    """The question that is answered, its class, and the outcome of the checks.

    Adds ``last_user``, ``meta``, ``suspicious``, ``alternative_used``,
    ``alternative_idx``, ``question``, ``detail``, ``status_code`` and
    ``route``. Failed checks end as status 500 carrying the text of the
    error they started as.
    """
    return requests.withColumn("_r", resolution(F.col("messages"))).select("*", "_r.*").drop("_r")
