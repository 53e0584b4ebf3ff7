"""Keyed session state equals the batch history; forgetting; a hot chat in slices."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import conversation as C
from docloom.streaming import sessions as S

SCHEMA = "chat_id string, req_no long, step int, pos int, role string, content string"


def entries(seed, n, hot=0.7):
    """Messages and stored answers in any order of arrival, contents repeating."""
    rng = random.Random(seed)
    made = set()
    for _ in range(n):
        chat = "hot" if rng.random() < hot else f"c{rng.randrange(3)}"
        step, req_no = int(rng.random() < 0.2), rng.randrange(60)
        pos = 0 if step else rng.randrange(5)
        role = "assistant" if step or (req_no + pos) % 3 == 0 else "user"
        made.add((chat, req_no, step, pos, role, f"Text {rng.randrange(40)}"))
    rows = {}
    for row in sorted(made):
        rows.setdefault(row[:4] if row[2] == 0 else row, row)
    rows = list(rows.values())
    rng.shuffle(rows)
    return rows


def expected(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    answers = frame.where("step = 1").select("chat_id", "req_no", F.col("content").alias("answer"))
    history = C.history_with_answers(frame.where("step = 0"), answers).collect()
    found = {}
    for r in history:
        found.setdefault(r.chat_id, []).append(r)
    last = lambda rs: max(((r.req_no, r.pos, r.content) for r in rs if r.role == "user"), default=(0, 0, None))[2]
    return {chat: (len(rs), last(rs)) for chat, rs in found.items()}


def put(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def live(changes):
    return {r.chat_id: (r.history_length, r.last_user) for r in S.live_sessions(changes).collect()}


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    return S.run_sessions(stream, str(tmp_path / "out"), str(tmp_path / "state"), **options)


@pytest.mark.parametrize("slices", [1, 4])
def test_stream_equals_batch(spark, tmp_path, slices):
    rows = entries(slices, 400)
    for part in (rows[:200], rows[200:]):
        put(spark, part, str(tmp_path / "in"))
        changes = run(spark, tmp_path, slices=slices)
    assert live(changes) == expected(spark, rows)
    assert changes.where("chat_id = 'hot'").select("slice").distinct().count() == slices


def test_rows_that_come_again_change_nothing(spark, tmp_path):
    rows = entries(9, 60)
    for _ in range(2):
        put(spark, rows, str(tmp_path / "in"))
        changes = run(spark, tmp_path, slices=2)
    assert live(changes) == expected(spark, rows)


def test_last_message_that_came_earlier(spark, tmp_path):
    """A later copy arrives first; its earlier original makes another message the last one."""
    for rows in (
        [("c", 9, 0, 0, "user", "b"), ("c", 5, 0, 0, "user", "a"), ("c", 2, 0, 0, "user", None)],
        [("c", 1, 0, 0, "user", "b"), ("c", 1, 0, 1, "assistant", "")],
    ):
        put(spark, rows, str(tmp_path / "in"))
        changes = run(spark, tmp_path, slices=1)
    assert live(changes) == {"c": (4, "a")}


def test_forgotten_contents_count_again(spark, tmp_path):
    row = ("c", 1, 0, 0, "user", "Etage")
    put(spark, [row], str(tmp_path / "in"))
    run(spark, tmp_path, slices=1, ttl_ms=1000)
    time.sleep(2)
    put(spark, [("c", 2, 0, 0, "user", "Etage")], str(tmp_path / "in"))
    assert live(run(spark, tmp_path, slices=1, ttl_ms=1000)) == {"c": (2, "Etage")}


def test_empty_stream(spark, tmp_path):
    put(spark, [], str(tmp_path / "in"))
    assert live(run(spark, tmp_path)) == {}
