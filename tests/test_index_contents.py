"""Every stored column: what the query keeps on disk, and vectors of ids that are stored once or more often."""

import os
import re

from pyspark.sql import functions as F

from docloom.operators.embed import embed_hash
from docloom.plans.queries import QUERIES
from docloom.session import scratch_dir


def _texts(spark, top):
    """Documents of which two have one id, one is empty and one has no text."""
    texts = {1: "a b c", 2: "", 3: "d d e", 4: None, 5: "f", 6: "g h"}
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in texts.items()] + [(3, "x y", "en", "s1", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    return rows


def test_vectors_of_repeated_ids_are_gathered_and_others_are_not_moved(spark, tmp_path):
    rows = _texts(spark, tmp_path)
    held = f"{scratch_dir(spark)}/docloom"
    before = set(os.listdir(held)) if os.path.isdir(held) else set()
    stored = QUERIES["q_index_contents"](spark, str(tmp_path))
    assert not [n for n in set(os.listdir(held)) - before if n.startswith("nodes-")]
    text = stored._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "Aggregate" not in text
    vectors = embed_hash(spark.createDataFrame([(r[0], r[1] or "") for r in rows], "doc_id long, text string")).collect()
    wanted = {}
    for r in vectors:
        wanted.setdefault(str(r.doc_id), []).extend((f"{i}:{w:.4f}") for i, w in enumerate(r.embedding) if w)
    found = stored.select("doc_id", "level", "text", "vector").collect()
    assert len([r for r in found if r.doc_id != "4"]) == 3 * 6
    for r in found:
        assert (r.vector.split(" ") if r.vector else []) == sorted(wanted[r.doc_id]), r
        assert r.vector is None or re.fullmatch(r"\d+:\d\.\d{4}( \d+:\d\.\d{4})*", r.vector)
    assert {r.doc_id for r in found if r.vector is None} == {"2", "4"}
