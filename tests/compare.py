"""Run registered queries next to their SQL and compare the rows.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return int(value) if value.is_integer() and math.isfinite(value) else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )


def differences(spark, con, folder: str, query, sql: str) -> list[str]:
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    found = []
    if sorted(df.columns) != sorted(names):
        found.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if len(got) != len(want):
        found.append(f"rows {len(got)} != {len(want)}")
    for a, b in zip(got, want):
        if a != b:
            found.append(f"first difference:\n  spark  {a}\n  duckdb {b}")
            break
    if not want:
        found.append("no rows to compare")
    return found


def main(folder: str, chosen: list[str]) -> int:
    from harborlane.plans import catalog
    from harborlane.session import build_session

    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name in chosen or queries:
        began = time.time()
        try:
            if name in oracles:
                found = differences(spark, con, folder, queries[name], oracles[name])
            else:
                found = []
                print(f"{name}: no SQL, {queries[name](spark, folder).count()} rows")
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - began:.2f}s")
        for line in found:
            print("    " + line[:1500])
    print(f"{bad} of {len(chosen or queries)} differ")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    at = args[0] if args else "/root/testdata/sf0.01"
    sys.exit(bool(main(at, args[1:])))
