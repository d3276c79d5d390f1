"""Runs registered queries next to their SQL on the same files and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import time

import duckdb

from sitegrain.plans.landed import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    """(ok, message) of one query."""
    start = time.time()
    frame = fn(spark, sf_dir)
    got_columns, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.time() - start
    if sql is None:
        return True, f"rows {len(got)} {spent:.1f}s (no SQL)"
    start = time.time()
    result = con.execute(sql)
    want_columns, want = rows_of([c[0] for c in result.description], result.fetchall())
    note = f"rows {len(got)}/{len(want)} {spent:.1f}s sql {time.time() - start:.1f}s"
    if got_columns != want_columns:
        return False, f"{note} columns {got_columns} != {want_columns}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lack = [r for r in want if r not in set(got)][:2]
        return False, f"{note} only spark {str(extra)[:700]} only sql {str(lack)[:700]}"
    return True, note


if __name__ == "__main__":
    import sys

    from __spark_entry__ import oracle_sql, queries
    from sitegrain.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf), oracle_sql(), []
    for name, fn in queries().items():
        if only and not any(o in name for o in only):
            continue
        try:
            ok, note = compare(spark, con, sf, name, fn, oracles.get(name))
        except Exception as err:  # noqa: BLE001
            ok, note = False, f"{type(err).__name__} {str(err)[:900]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
