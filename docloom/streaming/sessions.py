"""Keyed session state: history length and last user message of each chat, as a stream.

The state of a chat is cut into slices by content, so a chat that holds a
third of all messages is that many keys and not one task. A content belongs to
one slice, so merging by content needs no other slice: lengths add up, and the
last user message is the latest of the slices' own.

A slice keeps in the state store, per content, the earliest order of its
entries, per stored answer a mark, and one summary row. A micro-batch reads and
writes only the contents that it brings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import with_conf
from .sink import AVAILABLE, ONE_BATCH, run_changes

SLICES = 16
PROVIDER = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
}
# version counts the micro-batches that changed a slice; last_* is its latest user message.
SUMMARY = "version long, history_length long, last_no long, last_pos long, last_user string"
SESSION = f"chat_id string, slice int, {SUMMARY}"
FIRST = "req_no long, step int, pos long, is_user boolean, text string"


class SessionSlice(StatefulProcessor):
    """Merges the entries of one slice of a chat and emits its summary."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "content_key string", FIRST, self.ttl_ms)
        self.answers = handle.getMapState("answers", "content_key string, req_no long", "seen boolean", self.ttl_ms)
        self.summary = handle.getValueState("summary", SUMMARY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.summary.get() or (0, 0, None, None, None)
        version, length, *last = kept
        last = tuple(last)
        for part in rows:
            part = part.sort_values(["req_no", "step", "pos"], kind="stable")
            for content_key, req_no in part[part.step == 1][["content_key", "req_no"]].drop_duplicates().itertuples(index=False):
                answer = (content_key, int(req_no))
                known = self.answers.containsKey(answer)
                length += not known
                if not known or self.ttl_ms:
                    self.answers.updateValue(answer, (True,))
            for row in part.drop_duplicates("content_key").itertuples(index=False):
                grown, last = self._merge(row, last)
                length += grown
        self.summary.update((version + 1, length, *last))
        chat_id, number = key
        columns = [c.split()[0] for c in SESSION.split(", ")]
        yield pd.DataFrame([(chat_id, number, version + 1, length, *last)], columns=columns, dtype=object)

    def _merge(self, row, last: tuple) -> tuple[int, tuple]:
        """Take in the earliest entry of a content; by how much the history grows, and the last user message."""
        content_key = (row.content_key,)
        old = self.first.getValue(content_key)
        order = (int(row.req_no), int(row.step), int(row.pos))
        if old is not None and tuple(old[:3]) <= order:
            if self.ttl_ms:
                self.first.updateValue(content_key, tuple(old))
            return 0, last
        is_user = row.role == "user" and row.step == 0
        self.first.updateValue(content_key, (*order, is_user, row.content if is_user else None))
        grown = (row.step == 0) - (old is not None and old[1] == 0)
        if old is not None and old[3] and (old[0], old[2]) == last[:2]:
            # The last message turned out to be an earlier one: look for the one before it.
            users = [(v[0], v[2], v[4]) for v in self.first.values() if v[3]]
            last = max(users, key=lambda v: v[:2], default=(None, None, None))
        elif is_user and (last[0] is None or (order[0], order[2]) > last[:2]):
            last = (order[0], order[2], row.content)
        return grown, last

    def close(self) -> None:
        pass


def session_stream(entries: DataFrame, slices: int = SLICES, ttl_ms: int | None = None) -> DataFrame:
    """The summary of every slice that a micro-batch changes.

    Entries are messages (``step`` 0) and stored answers (``step`` 1), as in
    ``merge_stream``; a null content is a content of its own, rows that come
    again change nothing, and order of arrival plays no part. ``slices`` must
    stay the same for one checkpoint. With ``ttl_ms`` the store forgets a
    content that has not come for that long (processing time): the history
    length keeps it, and if it comes once more it counts as new.
    """
    placed = entries.select(
        "chat_id",
        F.pmod(F.xxhash64("content"), F.lit(slices)).cast("int").alias("slice"),
        F.coalesce(F.sha2("content", 256), F.lit("-")).alias("content_key"),
        F.col("req_no").cast("long").alias("req_no"),
        F.col("step").cast("int").alias("step"),
        F.col("pos").cast("long").alias("pos"),
        "role",
        "content",
    )
    return placed.groupBy("chat_id", "slice").transformWithStateInPandas(
        SessionSlice(ttl_ms), SESSION, "Update", "None" if ttl_ms is None else "ProcessingTime"
    )


def live_sessions(changes: DataFrame) -> DataFrame:
    """History length and last user message per chat: the newest summaries of its slices, added up."""
    newest = changes.groupBy("chat_id", "slice").agg(
        F.max_by(F.struct("history_length", "last_no", "last_pos", "last_user"), "version").alias("s")
    )
    latest = F.when(F.col("s.last_no").isNotNull(), F.struct("s.last_no", "s.last_pos"))
    return newest.groupBy("chat_id").agg(
        F.sum("s.history_length").alias("history_length"), F.max_by("s.last_user", latest).alias("last_user")
    )


def run_sessions(
    entries: DataFrame, path: str, checkpoint: str, slices: int = SLICES, ttl_ms: int | None = None
) -> DataFrame:
    """Run the stream over what is available and return the table of changes.

    With ``ttl_ms`` that is one micro-batch: a stream on processing time always
    has a next one, as time passes without rows too.
    """
    with with_conf(entries.sparkSession, PROVIDER):
        stream = session_stream(entries, slices, ttl_ms)
        return run_changes(stream, path, checkpoint, AVAILABLE if ttl_ms is None else ONE_BATCH)
