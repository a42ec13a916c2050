"""Run queries beside their SQL in DuckDB and compare rows regardless of order.

python -m tests.oracle [folder] [name ...]
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

#: Queries that SQL can't express: other tests hold them against plain code, brute force or held-out labels.
CHECKED_ELSEWHERE = {"pipeline", "op1_quality", "op2_token_counts", "op3_toxicity", "op4_near_vectors", "op6_mixing", "op7_packing", "op9_main_text",
                     "op10_url_rules", "op12_secrets", "op13_periodic_runs"}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, connection, folder, name, function, sql):
    frame = function(spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return f"rows {len(got[1])}, without SQL", name in CHECKED_ELSEWHERE
    relation = connection.sql(sql)
    want = rows_of(relation.columns, relation.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", False
    if got[1] != want[1]:
        left, right = set(got[1]), set(want[1])
        return (f"rows {len(got[1])} vs {len(want[1])}; only ours {sorted(left - right, key=repr)[:3]}; "
                f"only oracle {sorted(right - left, key=repr)[:3]}; columns {got[0]}"), False
    return f"rows {len(got[1])}", True


def main() -> None:
    import __spark_entry__ as entry
    from shelfwise.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = local_session(os.environ.get("CORES", "8"))
    connection = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, function in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            message, ok = compare(spark, connection, folder, name, function, oracles.get(name))
        except Exception as error:
            message, ok = f"{type(error).__name__}: {str(error)[:1500]}", False
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok ' if ok else 'BAD'} {kind} {name:28} {time.time() - start:6.1f}s {message}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
