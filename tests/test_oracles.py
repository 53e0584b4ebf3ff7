"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as E

QUERIES, SQL = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    assert compare.differences(spark, con, name, QUERIES[name], SQL.get(name), small) is None


def test_catalogue():
    assert set(SQL) <= set(QUERIES)
    assert {name for name in QUERIES if name.startswith("q_")} <= set(SQL)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "answer"]
    assert df.count() == 500


def test_fixtures_reach_every_branch(spark, small):
    from docloom.operators.requests import resolve
    from docloom.plans import inputs

    resolved = resolve(inputs.requests(spark, "/root/testdata/sf0.01"))
    seen = {
        (r.route, r.type, r.suspicious, r.alternative_used)
        for r in resolved.select("route", "meta.type", "suspicious", "alternative_used").distinct().collect()
    }
    assert {("meta", t, False, False) for t in ("title", "tags", "unknown")} <= seen
    assert {("retrieval", None, True, True), ("retrieval", None, True, False)} <= seen
    assert {("retrieval", None, False, False), ("error", None, False, False)} <= seen
