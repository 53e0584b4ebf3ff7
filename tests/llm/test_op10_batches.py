"""Rows that carry packed counts reach the tasks a few at a time."""

from docloom.llm import lmscore

RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_packed_rows_come_in_small_batches(spark, monkeypatch):
    kept, seen = spark.conf.get(RECORDS), []
    write = lmscore.materialize

    def watched(df, name, codec="snappy"):
        seen.append((name, int(spark.conf.get(RECORDS))))
        return write(df, name, codec)

    monkeypatch.setattr(lmscore, "materialize", watched)
    docs = spark.createDataFrame([(i, f"a b c w{i % 7}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert lmscore.score(docs, labels).count() == 40
    assert {n for name, n in seen if name in ("lm-answers", "lm-scores")} == {256}
    assert spark.conf.get(RECORDS) == kept
