import json

import pytest
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.operators import citations as A
from docloom.operators.embed import embedder, hash_model
from docloom.operators.knn import knn_blocks
from docloom.operators.records import (
    AUDIT,
    audit_lines,
    chat_response,
    ollama_response,
    ollama_response_timed,
    stamp_text,
)
from docloom.plans import answer as P
from docloom.schemas import CHAT_REQUEST, NODE
from docloom.sources.index import Collection


embed_model = embedder(hash_model())


def cite(spark, answer, cited):
    df = spark.createDataFrame([(answer, cited)], "a string, c array<string>")
    return df.select(A.with_sources(F.col("a"), F.col("c")).alias("a")).first().a


ONE, TWO = "(Quelle: a.pdf, Seite: 1)", "(Quelle: b.pdf, Seite: N/A)"


@pytest.mark.parametrize("answer", ["Hier.", f"Siehe {ONE.upper()}", f"Siehe {TWO.lower()} und mehr"])
def test_sources_block(spark, answer):
    got = cite(spark, answer, [ONE, TWO])
    if "siehe" in answer.lower():
        assert got == answer
    else:
        assert got == f"{answer}{fixed.SOURCES_HEADING}{ONE}\n{TWO}"
    assert cite(spark, got, [ONE, TWO]) == got


def test_no_sources(spark):
    assert cite(spark, "Hier.", []) == "Hier."


def test_citations_sort_by_code_point_and_keep_hit_order(spark):
    rows = [(1, 1, "b", "a.pdf", 2), (1, 2, "c", "a.pdf", 10), (1, 3, "d", "a.pdf", 2), (1, 4, "e", None, None)]
    found = spark.createDataFrame(rows, "query_id int, rank int, text string, filename string, page_number int")
    row = A.citations(found).first()
    assert row.citations == [
        "(Quelle: Unbekanntes Dokument, Seite: N/A)", "(Quelle: a.pdf, Seite: 10)", "(Quelle: a.pdf, Seite: 2)"
    ]
    assert row.sources == "a.pdf:2, a.pdf:10, a.pdf:2, Unbekannt:N/A"
    assert (row.source_nodes_count, row.unique_sources_count) == (4, 3)
    assert A.context_text(found).first().context == "".join(f"\n\nDokument {i}:\n{t}" for i, t in enumerate("bcde", 1))


@pytest.mark.parametrize("n", [2000, 2001])
def test_prompt_truncation(spark, n):
    got = spark.range(1).select(A.truncate_prompt(F.lit("p" * n)).alias("p")).first().p
    assert got == ("p" * n if n <= 2000 else "p" * 1500 + "\n\nAntwort:")


def test_prompt_without_context(spark):
    got = spark.range(1).select(A.prompt(F.lit(None).cast("string"), F.lit("Was?"), "Du.").alias("p")).first().p
    assert got == "Du.\n\nKontext aus Dokumenten:\n\nFrage: Was?\n\nAntwort:"


def test_response_records(spark):
    response = chat_response(F.lit("0123456789"), F.lit(True), F.lit(5), F.lit("m"), F.lit("T"))
    df = spark.range(1).select(response.alias("r"))
    row = json.loads(df.select(F.to_json("r")).first()[0])
    assert row == {
        "id": "chatcmpl-01234567-meta", "object": "chat.completion", "created": 5, "model": "m",
        "choices": [{"index": 0, "message": {"role": "assistant", "content": "T"}, "finish_reason": "stop"}],
        "usage": {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0}, "chat_id": "0123456789",
    }
    plain = json.loads(df.select(F.to_json(ollama_response(F.col("r"), F.lit("m")))).first()[0])
    assert plain == {
        "model": "m", "created_at": "2024-06-07T16:00:00Z", "message": {"role": "assistant", "content": "T"}, "done": True
    }
    for stream in (True, False):
        timed = ollama_response_timed(F.col("r"), F.lit("m"), F.lit("now"), F.lit(stream))
        got = json.loads(df.select(F.to_json(timed)).first()[0])
        assert ("eval_count" in got) is not stream and got["created_at"] == "now"


def test_stamp(spark):
    got = spark.range(1).select(stamp_text(F.timestamp_millis(F.lit(1700000000123))).alias("s")).first().s
    assert got == "20231114_221320_123"


@pytest.fixture(scope="module")
def answered(spark, tmp_path_factory):
    """Five requests of one chat: answered, meta, failed generator, answered again, rejected."""
    meta = " ".join(fixed.TITLE_MARKERS)
    rows = [
        ("r0", 0, [("user", "rote Wand im Keller")], "Antwort null"),
        ("r1", 1, [("user", "rote Wand im Keller"), ("user", meta)], None),
        ("r2", 2, [("user", "blaue Decke im Flur")], None),
        ("r3", 3, [("user", "rote Wand im Keller"), ("assistant", "Antwort null"), ("user", "blaue Decke im Flur")],
         "Antwort drei (QUELLE: B.PDF, SEITE: N/A)"),
        ("r4", 4, [("user", "x")], "egal"),
    ]
    requests = spark.createDataFrame(
        [(i, n, "chat", None, None, None, m) for i, n, m, _ in rows], CHAT_REQUEST
    ).join(spark.createDataFrame([(r[0], r[3]) for r in rows], "request_id string, answer string"), "request_id")
    nodes = embed_model(
        spark.createDataFrame(
            [("n1", "rote Wand im Keller", "a.pdf", 7), ("n2", "blaue Decke im Flur", "b.pdf", None)],
            "node_id string, text string, filename string, page_number int",
        )
    )
    metadata = F.struct(F.lit("p").alias("file_path"), F.lit("d").alias("file_directory"), "filename", "page_number")
    nodes = nodes.withColumns({"metadata": metadata, "level": F.lit(0), **{
        f.name: F.lit(None) for f in NODE.fields if f.name not in (*nodes.columns, "metadata", "level")
    }})
    index = Collection(spark, str(tmp_path_factory.mktemp("index")), "c")
    index.rebuild(nodes)
    exact = P.retrieve(P.prepare(requests), index, embed_model, 1, lambda q, k: knn_blocks(q, nodes, k))
    found = P.retrieve(P.prepare(requests), index, embed_model, 1)
    assert sorted(map(str, found.collect())) == sorted(map(str, exact.collect()))
    return P.answer_requests(requests, index, embed_model, k=1)


def test_answers(answered):
    got = {r.request_id: r for r in answered.collect()}
    assert got["r0"].response_text == f"Antwort null{fixed.SOURCES_HEADING}(Quelle: a.pdf, Seite: 7)"
    assert (got["r1"].route, got["r1"].response_text) == ("meta", fixed.META_FALLBACK_TITLE)
    assert (got["r2"].route, got["r2"].status_code, got["r2"].detail) == ("error", 500, fixed.ERROR_ENGINE)
    assert got["r3"].response_text == "Antwort drei (QUELLE: B.PDF, SEITE: N/A)"
    assert got["r4"].detail == fixed.ERROR_TOO_SHORT


def test_history_keeps_cited_answers_and_rejected_messages(answered):
    rows = P.history(answered).orderBy("req_no", "step", "pos").collect()
    assert [(r.req_no, r.role, r.content) for r in rows] == [
        (0, "user", "rote Wand im Keller"),
        (0, "assistant", f"Antwort null{fixed.SOURCES_HEADING}(Quelle: a.pdf, Seite: 7)"),
        (1, "user", " ".join(fixed.TITLE_MARKERS)),
        (2, "user", "blaue Decke im Flur"),
        (3, "assistant", "Antwort null"),
        (3, "assistant", "Antwort drei (QUELLE: B.PDF, SEITE: N/A)"),
        (4, "user", "x"),
    ]


def test_audit(answered):
    rows = {r.request_id: r for r in P.audit(answered).collect()}
    assert set(rows) == {"r0", "r1", "r3"}
    assert [rows["r1"][k] for k in AUDIT] == [True, "title", 1.0, fixed.META_METHOD, None, None, 3, 0, 0]
    assert [rows["r0"][k] for k in AUDIT] == [None, None, None, None, False, False, 2, 1, 1]
    assert rows["r3"].chat_history_length == 6


def test_audit_lines(answered):
    records = P.audit(answered).withColumn("logged_at", F.timestamp_seconds(F.lit(0)))
    lines = [r.line for r in audit_lines(records).where("request_id = 'r0'").orderBy("line_no").collect()]
    assert lines == [
        "========== DEBUG-EINTRAG 19700101_000000_000 ==========",
        "🔍 EINGEHENDE REQUEST-DATEN: Chat-ID=chat, Model=llama3.2:1b",
        "🔧 suspicious_message_detected: False",
        "🔧 alternative_question_used: False",
        "🔧 chat_history_length: 2",
        "🔧 source_nodes_count: 1",
        "🔧 unique_sources_count: 1",
        "✅ USER-MESSAGE: 'rote Wand im Keller...' (Länge: 19)",
        "🤖 RAG-ANTWORT: 'Antwort null...' (Länge: 12)",
        "📄 QUELLEN: a.pdf:7",
        "========== ENDE DEBUG-EINTRAG 19700101_000000_000 ==========",
    ]


def test_responses(answered):
    got = {r.request_id: r.response for r in P.respond(answered, F.lit(1)).collect()}
    assert {k: v.id for k, v in got.items()} == {
        "r0": "chatcmpl-chat", "r1": "chatcmpl-chat-meta", "r3": "chatcmpl-chat"
    }


def test_generator_hook(spark):
    from docloom.operators.generate import generator_column, with_generated

    meta = " ".join(fixed.TITLE_MARKERS)
    rows = [("a", 0, "c", None, None, None, [("user", "Was ist rot?")]), ("b", 1, "c", None, None, None, [("user", meta)]),
            ("c", 2, "c", None, None, None, [("user", "Was ist kaputt?")]), ("d", 3, "c", None, None, None, [])]
    prepared = P.prepare(spark.createDataFrame(rows, CHAT_REQUEST))
    found = spark.createDataFrame([("a", 1, "Die Wand ist rot.")], "query_id string, rank int, text string")

    def load():
        def generate(prompt):
            if "kaputt" in prompt:
                raise RuntimeError("no answer")
            return f"<{prompt[-40:]}>"

        return generate

    asked = P.prompts(prepared, found)
    generated = with_generated(asked, generator_column(load))
    got = {r.request_id: r for r in generated.collect()}
    assert "\n\nDokument 1:\nDie Wand ist rot.\n\nFrage: Was ist rot?\n\nAntwort:" in got["a"].prompt
    assert got["a"].answer.endswith("Was ist rot?\n\nAntwort:>") and got["b"].prompt == meta
    assert got["b"].answer and got["c"].answer is None and got["d"].prompt is None and got["d"].answer is None
    assert got["c"].generator_error == "no answer" and got["a"].generator_error is None
    answered = P.answer(generated, A.citations(found.selectExpr("*", "'f.pdf' filename", "1 page_number")))
    ends = {r.request_id: (r.status_code, r.detail) for r in answered.collect()}
    assert ends["c"] == (500, "500: Chat-Engine Fehler: no answer") and ends["a"] == (200, None)


def test_a_node_hit_by_most_queries(spark):
    hits = spark.range(3000).selectExpr("id query_id", "case when id % 3 > 0 then 'hot' else 'n' || id % 7 end node_id")
    nodes = spark.createDataFrame([("hot", 1), ("n0", 2), ("n3", 3), ("n6", 4), ("other", 5)], "node_id string, page int")
    got = A.hits_with_metadata(hits, nodes)
    assert got.columns == ["node_id", "query_id", "page"] or set(got.columns) == {"node_id", "query_id", "page"}
    expected = hits.where("node_id in ('hot', 'n0', 'n3', 'n6')").count()
    assert got.count() == expected and got.where("node_id = 'hot'").select("page").distinct().count() == 1
