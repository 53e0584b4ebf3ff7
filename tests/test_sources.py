import json
import os
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import elements as G
from docloom.sources import elements as E
from docloom.sources import files, logs
from docloom.sources.chat import read_ollama, read_requests


def touch(path, content=b"x", age=0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    stamp = time.time() - age
    os.utime(path, (stamp, stamp))


def test_folder_scan(spark, tmp_path):
    touch(tmp_path / "a.pdf")
    touch(tmp_path / "B.PDF")
    touch(tmp_path / "c.txt")
    touch(tmp_path / "sub" / "d.pdf")
    names = [os.path.basename(r.path) for r in files.scan_folder(spark, str(tmp_path)).collect()]
    assert names == ["a.pdf"]
    assert files.scan_folder(spark, str(tmp_path), with_content=True).first().content == b"x"


def test_tree_scan_newest_wins(spark, tmp_path):
    touch(tmp_path / "x" / "a.pdf", b"old", age=100)
    touch(tmp_path / "y" / "z" / "a.pdf", b"newer", age=10)
    touch(tmp_path / "b.pdf")
    touch(tmp_path / "y" / "c.txt")
    got = {r.filename: (r.length, r.path) for r in files.scan_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.pdf", "b.pdf"}
    assert got["a.pdf"][0] == 5 and got["a.pdf"][1].endswith("/y/z/a.pdf")


def test_name_clash_on_one_time_takes_the_greatest_path(spark):
    df = spark.createDataFrame(
        [("p/a.pdf", 1, 1), ("q/a.pdf", 1, 2), ("r/a.PDF", 9, 3)], "path string, t long, length long"
    ).select("path", F.timestamp_seconds("t").alias("modificationTime"), "length")
    assert [tuple(r) for r in files.one_per_name(df).select("filename", "path").collect()] == [("a.pdf", "q/a.pdf")]


ELEMENTS = [
    {"text": "Titel", "type": "Title", "metadata": {"page_number": 1, "x": 2}},
    {"type": "Text", "metadata": {}},
    {"text": "ohne"},
]


def test_element_json(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps(ELEMENTS, indent=1))
    expected = [("Titel", "Title", 1), ("", "Text", None), ("ohne", "unbekannt", None)]
    got = E.read_element_json(spark, str(tmp_path)).select("text", "type", "page_number", "filename").collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(expected, key=str) or {
        tuple(r)[:3] for r in got
    } == set(expected)
    assert {r.filename for r in got} == {"doc.json"}
    df = spark.createDataFrame([("f/doc.pdf", json.dumps(ELEMENTS)), ("f/bad.pdf", "{"), ("f/no.pdf", "[]")],
                               "file_path string, json string")
    rows = E.parse_element_json(df).orderBy("elem_idx").collect()
    assert [(r.text, r.type, r.page_number) for r in rows] == expected
    assert {(r.file_directory, r.filename) for r in rows} == {("f", "doc.pdf")}


def extractors():
    """Built here so that Spark ships them by value: its workers cannot import this file."""

    def with_strategy(content, strategy):
        if content == b"boom":
            raise RuntimeError("broken file")
        return [("Title", f"{strategy}:{content.decode()}", 1), (None, None, None)] if content else []

    def without_strategy(content):
        return [("Title", content.decode(), None)]

    def other_type_error(content, strategy):
        raise TypeError("something else")

    return with_strategy, without_strategy, other_type_error


def test_extraction_isolates_failures(spark):
    with_strategy, without_strategy, other_type_error = extractors()
    df = spark.createDataFrame(
        [("a/1.pdf", b"eins"), ("a/2.pdf", b"boom"), ("a/3.pdf", b"")], "file_path string, content binary"
    )
    out = E.extract(df, with_strategy, "hi_res")
    status = {(r.status, r.error): (r.n_files, r.n_elements) for r in E.extract_status(out).collect()}
    assert status == {("loaded", None): (1, 2), ("failed", "RuntimeError"): (1, 0), ("empty", None): (1, 0)}
    rows = E.loaded_elements(out).orderBy("elem_idx").collect()
    assert [(r.filename, r.text, r.type, r.page_number) for r in rows] == [
        ("1.pdf", "hi_res:eins", "Title", 1), ("1.pdf", "", "unbekannt", None)
    ]
    used = {r.strategy_used for r in E.extract(df.limit(1), without_strategy).collect()}
    assert used == {"default"}
    assert E.extract(df.limit(1), other_type_error).first().error == "TypeError"


def test_any_type_error_is_retried_without_strategy(spark):
    def picky(content, **options):
        if options:
            raise TypeError("unsupported operand")
        return [("Title", "found", 1)]

    df = spark.createDataFrame([("a/1.pdf", b"eins")], "file_path string, content binary")
    row = E.extract(df, picky).first()
    assert (row.status, row.strategy_used, row.text) == ("loaded", "default", "found") and row.seconds >= 0


def test_chain_of_extractors(spark):
    def external(content, strategy):
        if content == b"boom":
            raise RuntimeError("service down")
        return [("Title", "external", 1)] if content == b"eins" else []

    def local(content, strategy):
        return [("Text", "local", None)] if content != b"none" else []

    df = spark.createDataFrame(
        [("1", b"eins"), ("2", b"boom"), ("3", b"zwei"), ("4", b"none")], "file_path string, content binary"
    )
    got = {r.file_path: (r.status, r.strategy_used, r.text) for r in E.extract(df, [("external", external), ("local", local)]).collect()}
    assert got == {
        "1": ("loaded", "external", "external"), "2": ("loaded", "local", "local"),
        "3": ("loaded", "local", "local"), "4": ("empty", "local", None),
    }


def test_element_files_reach_the_index(spark, tmp_path):
    from docloom.plans.ingest import build_nodes
    from docloom.sources.index import Collection

    (tmp_path / "json").mkdir()
    for name in ("a", "b"):
        (tmp_path / "json" / f"{name}.json").write_text(json.dumps(ELEMENTS, indent=1))
    found = E.read_element_json(spark, str(tmp_path / "json"))
    assert sorted((r.filename, r.elem_idx) for r in found.collect()) == [(f"{n}.json", i) for n in "ab" for i in range(3)]
    index = Collection(spark, str(tmp_path / "index"), "c")
    index.rebuild(build_nodes(found))
    assert index.count() == 18 and index.read().select("node_id").distinct().count() == 18


def test_fallback(spark):
    df = spark.createDataFrame([(["a"], ["b"]), ([], ["b"])], "a array<string>, b array<string>")
    value, used = E.with_fallback(F.col("a"), F.col("b"), ("first", "second"))
    assert [tuple(r) for r in df.select(value, used).collect()] == [(["a"], "first"), (["b"], "second")]


def test_log(spark, tmp_path):
    path = tmp_path / "app.log"
    path.write_text("".join(f"2024-01-01 00:00:{i:02d},000 - INFO -   Zeile {i}  \n" for i in range(60)) + "Traceback\n")
    lines = logs.read_log(spark, str(path))
    last = logs.tail(lines, ["logged_at"], 2).collect()
    assert [(r.level, r.message) for r in last] == [("INFO", "Zeile 59"), ("INFO", "Zeile 58")]
    assert lines.where("level = ''").count() == 1


def test_audit_sink(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1700000000), ("r2", 1700090000)], "request_id string, t long").select(
        "request_id", F.timestamp_seconds("t").alias("logged_at")
    )
    for _ in range(2):
        logs.write_audit(df, str(tmp_path / "audit"))
    back = spark.read.json(str(tmp_path / "audit"))
    assert back.count() == 4 and back.select("day").distinct().count() == 2


def test_request_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        json.dumps({"request_id": "a", "messages": [{"role": "user", "content": "x"}], "temperature": 0.5}) + "\n"
    )
    row = read_requests(spark, str(tmp_path)).first()
    assert (row.messages[0].content, row.temperature, row.model, row.chat_id) == ("x", 0.5, None, None)
    assert read_ollama(spark, str(tmp_path)).first().prompt is None


@pytest.fixture(scope="module")
def report_rows(spark):
    rows = [("d/a.pdf", i, "x" * 700, None if i % 4 == 3 else 1 + i // 3) for i in range(12)]
    rows += [("d/b.pdf", 0, "", None), (None, 0, "y", 3)]
    return spark.createDataFrame(rows, "file_path string, elem_idx int, text string, page_number int")


def test_reports(report_rows):
    got = {r.file_path: (r.n_elements, r.n_pages, r.n_chars) for r in G.file_report(report_rows).collect()}
    assert got == {"d/a.pdf": (12, 4, 8400), "d/b.pdf": (1, 0, 0), "Unbekannt": (1, 1, 1)}
    text = {r.filename: (r.total_text, r.pages_text) for r in G.file_report_text(G.file_report(report_rows)).collect()}
    assert text["a.pdf"] == ("8,400 Zeichen", "4") and text["b.pdf"] == ("0 Zeichen", "Keine oder nur N/A")
    pages = G.pages_per_file(report_rows).where("file_path = 'd/a.pdf'").orderBy("place").collect()
    assert [(r.place, r.page_number) for r in pages] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    first = {r.file_path: (r.lengths_and_pages, r.pages) for r in G.first_elements_report(report_rows).collect()}
    assert first["d/a.pdf"] == ("700:1 700:1 700:1 700:N/A 700:2", "1,2")
    assert first["d/b.pdf"] == ("0:N/A", "")


def test_metadata_size_of_nothing_is_zero(spark, report_rows):
    empty = spark.createDataFrame(
        [], "file_path string, file_directory string, filename string, page_number int"
    )
    assert G.metadata_size(empty).first().avg_metadata_size == 0


def test_whitelist(spark):
    m = F.create_map(*[F.lit(x) for kv in {"filename": "a", "languages": "de", "page_number": "1"}.items() for x in kv])
    assert spark.range(1).select(G.whitelist(m).alias("m")).first().m == {"filename": "a", "page_number": "1"}
