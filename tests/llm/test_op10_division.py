from docloom.llm import lmscore


def test_a_document_that_is_all_of_the_background_divides_by_nothing(spark):
    """Without its own counts nothing is left; nor of a table of blank texts."""
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for texts in (["eins zwei zwei"], [" "], [None, ""]):
        docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
        got = lmscore.score(docs, labels).collect()
        assert len(got) == len(texts)
        assert all((r.score is None) == (not (texts[r.doc_id - 1] or "").strip()) for r in got)
