"""Compare registered queries with their reference SQL on DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return value if isinstance(value, (int, str, bool)) else str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


def check(spark, con, sf_dir, name, function, sql):
    started = time.time()
    df = function(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if sql is None:
        return seconds, len(got), "rows-only"
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    a, b = normal(df.columns, got), normal(want_columns, want)
    if a == b:
        return seconds, len(got), "ok"
    detail = f"MISMATCH rows {len(got)} vs {len(want)} cols {a[0]} vs {b[0]}"
    if a[0] == b[0]:
        left, right = set(map(repr, a[1])), set(map(repr, b[1]))
        detail += f"\n  spark only: {sorted(left - right)[:2]}\n  sql only:   {sorted(right - left)[:2]}"
    return seconds, len(got), detail


if __name__ == "__main__":
    import __spark_entry__ as E
    from tracewright.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    session = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    connection = duck(sf)
    names = sys.argv[1:] or list(E.queries())
    sqls = E.oracle_sql()
    bad = 0
    for query_name in names:
        try:
            s, n, verdict = check(session, connection, sf, query_name, E.queries()[query_name], sqls.get(query_name))
        except Exception as error:
            s, n, verdict = 0.0, 0, f"ERROR {str(error)[:1500]}"
        bad += verdict not in ("ok", "rows-only")
        print(f"{query_name:32} {s:7.2f}s {n:8d} {verdict}", flush=True)
    print("bad:", bad)
