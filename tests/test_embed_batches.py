import hashlib

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import embed as E


def md5_vector(text, dim):
    out = np.zeros(dim)
    for token in text:
        out[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
    return out / np.linalg.norm(out)


def test_tokens_are_cut_at_ascii_white_space_and_hashed_as_utf8(spark):
    rows = [("a b  C\x0bd\x0ce\x1cf\n", ["a b", "c", "d", "e\x1cf"]), ("ÄÖ ß İx\t", ["äö ß", "i̇x"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, text string")
    model = E.embedder(E.hash_model(48))
    for got in (E.embed_hash(df, dim=48), model(df)):
        for r in got.collect():
            assert np.allclose(r.embedding, md5_vector(rows[r.i][1], 48), atol=1e-6)


def test_no_more_texts_than_a_batch_are_objects_at_once(spark):
    """One Arrow batch of many long texts goes to the model in slices, of unlike vectors too."""

    def load():
        def model(texts):
            assert len(texts) <= 16
            return [np.full(1 + len(text) % 2, len(text)) for text in texts]

        return model

    df = spark.range(0, 1000, 1, 1).select("id", F.expr("if(id % 9 = 0, null, repeat('x', cast(id AS int)))").alias("text"))
    got = df.withColumn("e", E.model_column(load, batch=16)("text"))
    for r in got.collect():
        n = 0 if r.id % 9 == 0 else r.id
        assert r.e == [float(n)] * (1 + n % 2)


def test_buckets_remember_tokens_up_to_a_limit(monkeypatch):
    monkeypatch.setattr(E, "REMEMBERED", 3)
    buckets = E.Buckets(16)
    texts = [b"a b c d e f", b"", b"f e a a"]
    for _ in range(2):
        found = buckets.vectors(texts)
    assert len(buckets) == 3 and not found[1].any()
    assert np.allclose(found[2], md5_vector(["f", "e", "a", "a"], 16))


def test_unknown_tokens_are_hashed_together(monkeypatch):
    """No token is hashed by itself but those of more than one MD5 block."""
    tokens = [hashlib.sha512(str(i).encode()).hexdigest()[: i % 70 + 1].encode() for i in range(500)] + ["äöü ß".encode()]
    asked = []
    md5 = hashlib.md5
    monkeypatch.setattr(E.hashlib, "md5", lambda token: (asked.append(token), md5(token))[1])
    found = E.Buckets(16).vectors([b" ".join(tokens[:300]), b" ".join(tokens[200:]), b"\t \n"])
    monkeypatch.undo()
    assert asked and min(map(len, asked)) > 55
    assert np.allclose(found[0], md5_vector([t.decode() for t in tokens[:300]], 16)) and not found[2].any()
    assert np.allclose(found[1], md5_vector(b" ".join(tokens[200:]).decode().split(), 16))
