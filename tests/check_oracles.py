"""Run registered queries and their SQL side by side.

    python tests/check_oracles.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from vigilog.session import build_session  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir):
    """None when equal, else a short account of the difference."""
    start = time.time()
    df = contract.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None, len(got), took
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}", len(got), took
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lacking = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} / {len(want)} rows; only here {extra}; only there {lacking}", len(got), took
    return None, len(got), took


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    failed = 0
    for query in sys.argv[2:] or contract.queries():
        try:
            problem, count, seconds = compare(session, connection, query, folder)
        except Exception as error:  # report and go on with the next query
            problem, count, seconds = f"{type(error).__name__}: {str(error)[:700]}", -1, 0.0
        sql_note = "" if query in contract.oracle_sql() else " (no SQL)"
        print(f"{'FAIL' if problem else 'ok  '} {query}{sql_note} rows={count} {seconds:.2f}s",
              problem or "", flush=True)
        failed += problem is not None
    print("failed:", failed)
