"""Run every registered query beside its SQL and compare values, order left out.

    python tests/check_oracle.py [folder] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, int) and not isinstance(value, bool):
        return float(f"{value:.9g}") if abs(value) < 10 ** 9 else value
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder: str, run, sql: str) -> str | None:
    """What differs, or None."""
    got = run(spark, folder)
    got_columns, got_rows = got.columns, [tuple(r) for r in got.collect()]
    relation = connection.execute(sql)
    want_columns, want_rows = [d[0] for d in relation.description], relation.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} / {sorted(want_columns)}"
    a, b = bag(got_columns, got_rows), bag(want_columns, want_rows)
    if a == b:
        return None
    return f"rows {len(got_rows)} / {len(want_rows)}; only Spark {str(list((a - b).items())[:2])[:400]}; only SQL {str(list((b - a).items())[:2])[:400]}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from millrace.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("FATAL")
    connection, sql = connect(folder), oracle_sql()
    bad = 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name not in sql:
                print(f"rows  {name}: {run(spark, folder).count()}", flush=True)
                continue
            problem = compare(spark, connection, folder, run, sql[name])
        except Exception as error:
            problem = f"{type(error).__name__} {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok   ' if problem is None else 'BAD  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
