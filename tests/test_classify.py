import pytest
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions import text as X
from docloom.functions.classify import is_flagged, is_suspicious, meta_answer, meta_verdict, with_verdict

TITLE, TAGS, GENERAL = fixed.TITLE_MARKERS, fixed.TAGS_MARKERS, fixed.GENERAL_MARKERS
CASES = [
    (" ".join(TITLE), "title", 1.0),
    (" ".join(TAGS), "title", 0.6),
    (" ".join(TAGS[1:]), "tags", 0.9),
    (" ".join(t for t in TAGS if t != "json format:"), "tags", 0.9),
    (" ".join(GENERAL[:4]), "unknown", 0.5),
    ("hi", None, 0.0),
    (" ".join(TITLE[:6]).upper(), "title", 0.6),
    (" ".join(TITLE[:5]), "unknown", 0.5),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    for frame in (with_verdict(df, "t"), df.withColumn("meta", meta_verdict(F.col("t")))):
        got = {r.i: r.meta for r in frame.collect()}
        for i, (_, kind, confidence) in enumerate(CASES):
            assert (got[i]["is_meta"], got[i]["type"], got[i]["confidence"]) == (
                kind is not None, kind, confidence
            )


@pytest.mark.parametrize(
    "text,suspicious,flagged",
    [
        ("Am Montag?", True, True),
        ("ETAGE", True, True),
        ("Generierung", True, True),
        ("Bitte erstelle eine Liste", False, True),
        ("Kategorisierung", True, False),
        ("Systemfrage", True, False),
        ("Wie hoch ist die Wand?", False, False),
    ],
)
def test_keywords(spark, text, suspicious, flagged):
    row = spark.range(1).select(is_suspicious(F.lit(text)).alias("s"), is_flagged(F.lit(text)).alias("f")).first()
    assert (row.s, row.f) == (suspicious, flagged)


def test_meta_answers(spark):
    df = spark.createDataFrame(
        [("title", None), ("tags", None), ("unknown", None), ("title", "x")], "t string, a string"
    )
    got = [r.a for r in df.select(meta_answer(F.col("t"), F.col("a")).alias("a")).collect()]
    assert got == [fixed.META_FALLBACK_TITLE, fixed.META_FALLBACK_TAGS, fixed.META_FALLBACK_OTHER, "x"]


def test_strip_equals_python(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"{s}a{s}b{s}" for s in spaces] + ["", " ", "".join(spaces), "​x​", "\ta\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", X.strip(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [t.strip() for t in texts]


@pytest.mark.parametrize("text", ["", "a" * 100, "ä😀" * 60, "x\ny"])
def test_previews(spark, text):
    c = F.lit(text)
    row = spark.range(1).select(
        X.preview(c, 100).alias("p"), X.preview_always(X.one_line(c), 70).alias("q"), F.length(c).alias("n")
    ).first()
    assert row.p == text[:100] + ("..." if len(text) > 100 else "")
    assert row.q == text[:70].replace("\n", " ") + "..."
    assert row.n == len(text)


@pytest.mark.parametrize(
    "path,folder,name", [("./PDFs/a.pdf", "./PDFs", "a.pdf"), ("a.pdf", "", "a.pdf"), ("/x/y/", "/x/y", "")]
)
def test_paths(spark, path, folder, name):
    row = spark.range(1).select(X.dir_name(F.lit(path)).alias("d"), X.base_name(F.lit(path)).alias("b")).first()
    assert (row.d, row.b) == (folder, name)


def test_urls(spark):
    url = F.lit("http://unstructured-api:8000/general/v0/general")
    row = spark.range(1).select(
        X.url_host(url).alias("h"), X.swap_host(url, "localhost").alias("s"), X.url_prefix(url, "/general/v0").alias("p")
    ).first()
    assert tuple(row) == (
        "unstructured-api", "http://localhost:8000/general/v0/general", "http://unstructured-api:8000"
    )
