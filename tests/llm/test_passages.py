import random

import corpus_pipeline


def test_passages_of_over_50_words_are_cut_and_others_stay(spark):
    """A passage of 51 words of 5.5 bytes with their gap in two documents; all other words are their own."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice((4, 5)))) for _ in range(n))
    passage, clean = words(51), words(120)
    assert 240 <= len(passage.encode()) < 400
    texts = {1: f"{words(40)} {passage} {words(40)}", 2: f"{words(30)} {passage} {words(50)}", 3: clean, 4: None}
    rows = [(i, t, "en", "a", len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert passage not in left[1] and passage not in left[2]
    assert all(len(texts[i]) - len(left[i]) in range(len(passage) - 1, len(passage) + 12) for i in (1, 2))
    assert left[3] == clean and left[4] is None
