"""Run registered queries and their SQL side by side and report differences."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return repr(value)
    return repr(int(value)) if isinstance(value, int) and not isinstance(value, bool) else repr(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def differences(spark, con, name, query, sql, sf_dir):
    """None when equal, else a short text."""
    df = query(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    left, right = rows(df.columns, got), rows(columns, result.fetchall())
    if left == right:
        return None
    a = [x for x in left if x not in set(right)][:2]
    b = [x for x in right if x not in set(left)][:2]
    return f"rows {len(left)} / {len(right)}; only spark {str(a)[:600]}; only sql {str(b)[:600]}"


if __name__ == "__main__":
    import __spark_entry__ as E
    from docloom.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sf_dir), E.queries(), E.oracle_sql()
    bad = 0
    for name in names or queries:
        t = time.time()
        try:
            text = differences(spark, con, name, queries[name], sql.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            text = f"{type(error).__name__}: {str(error)[:700]}"
        bad += text is not None
        kind = "sql" if name in sql else "rows"
        print(f"{name:28s} {kind:4s} {time.time() - t:6.1f}s {'ok' if text is None else 'DIFF ' + text}", flush=True)
    print("differences:", bad)
    sys.exit(bad > 0)
