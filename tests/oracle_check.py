"""Run registered queries and their SQL side by side and compare the rows.

    python -m tests.oracle_check [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sql_connection(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, bool):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, query, sql: str):
    """None when equal, else a short description of the difference."""
    df = query(spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        return f"rows {len(ours[1])} / {len(theirs[1])}; only ours {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    if not ours[1]:
        return "no rows"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from streamwarden.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = sql_connection(folder)
    sqls = oracle_sql()
    bad = 0
    for name, query in queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, folder, query, sqls[name])
            else:
                problem = None if query(spark, folder).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - start:.2f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
