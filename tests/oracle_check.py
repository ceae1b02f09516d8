"""Compare registered queries with their SQL answers: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, con, name, query, sql, folder):
    """None when equal, else a description of the difference."""
    df = query(spark, folder)
    got, got_cols = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want, want_cols = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}\n  {got[:2]}\n  {want[:2]}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(y) for y in b]:
            return f"{got_cols}\n  spark {a}\n  duck  {b}"
    return None


def main():
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark, con = make_session(), duck(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            error = compare(spark, con, name, queries[name], oracle.get(name), folder)
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {str(e)[:900]}"
        bad += error is not None
        kind = "sql " if name in oracle else "rows"
        print(f"{'ok  ' if error is None else 'FAIL'} {kind} {time.time() - start:6.2f}s {name} {error or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
