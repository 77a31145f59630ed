"""Run registered queries next to their DuckDB statements and compare the rows."""

from __future__ import annotations

import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from spinecat.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and v == int(v):
        return int(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_value(row[i]) for i in order) for row in rows),
        key=lambda r: [(x is not None, str(x)) for x in r],
    )


def compare(spark, con, sf: str, name: str) -> str:
    """Empty when equal, otherwise what differs."""
    df = entry.queries()[name](spark, sf)
    mine = rows_of(df.columns, df.collect())
    if name not in entry.oracle_sql():
        return ""
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)} rows"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a} != {b}"
    return ""


if __name__ == "__main__":
    folder = f"/root/testdata/sf{sys.argv[1]}"
    chosen = sys.argv[2:] or list(entry.queries())
    session = local_session()
    con = connect(folder)
    for q in chosen:
        began = time.time()
        try:
            problem = compare(session, con, folder, q)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        sql = "" if q in entry.oracle_sql() else " (no SQL)"
        print(f"{q:28s} {time.time() - began:6.1f}s {'ok' if not problem else problem}{sql}", flush=True)
