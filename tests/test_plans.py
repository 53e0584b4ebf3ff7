"""Plans keep the shape they were designed with."""

import pytest

from docloom.operators import chunks as K
from docloom.plans import inputs
from docloom.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NO_ACTION = [
    n for n in QUERIES
    if not n.startswith(("q_index", "q_stream", "q_knn", "q_build", "q_answer", "q_debug"))
]


@pytest.mark.parametrize("name", NO_ACTION)
def test_no_cross_join(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_chunking_is_narrow(spark, small):
    docs = inputs.table(spark, small, "documents").select("doc_id", "text")
    text = plan(K.chunk_hierarchical(docs))
    assert "Exchange" not in text
    assert text.count("split(") == 1


def test_resolution_is_evaluated_once(spark, small):
    text = plan(QUERIES["q_resolved_message"](spark, small))
    assert text.count("split(") == 0
    filtered = plan(QUERIES["q_response_ids"](spark, small))
    assert filtered.count("### chat history:") <= 2 * text.count("### chat history:")


def test_a_message_is_lower_cased_a_few_times(spark, small):
    assert plan(QUERIES["q_resolved_message"](spark, small)).count("lower(") <= 8


def test_pages_are_scanned_once(spark, small):
    text = plan(QUERIES["q_pages_per_file"](spark, small))
    assert "documents.parquet" not in text and "split(" not in text


@pytest.mark.parametrize("name", ["q_history_merge"])
def test_history_is_hash_aggregated(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    merge = [line for line in text.splitlines() if "Aggregate" in line and "content" in line and "collect_list" not in line]
    assert merge and not any("SortAggregate" in line for line in merge)


@pytest.mark.parametrize(
    "name,columns",
    [
        ("q_elements_by_type", "text:string"),
        ("q_path_parts", "doc_id:bigint,text:string,source:string"),
        ("q_last_user_message", "conv_id:bigint,turn:bigint,asks:boolean,role:string,content:string,question:bigint"),
    ],
)
def test_scans_read_only_what_is_used(spark, small, name, columns):
    schema = plan(QUERIES[name](spark, small)).split("ReadSchema: struct<")[1].split(">")[0]
    assert set(schema.split(",")) <= set(columns.split(","))


def test_top_k_is_cut_before_the_shuffle(spark, small):
    text = plan(QUERIES["q_knn_exact"](spark, small))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_first_elements_are_cut_before_the_shuffle(spark, small):
    assert plan(QUERIES["q_first_elements"](spark, small)).count("WindowGroupLimit") == 2
