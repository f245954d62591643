"""Run a registered query and its SQL on the same tables and compare them row by row.

    python tests/compare.py [--sf sf0.01] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(out, key=repr)


def difference(spark, con, sf, fn, sql):
    """None if equal, else a short description."""
    df = fn(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}; spark {got[:2]} sql {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first spark {bad[0][0]} sql {bad[0][1]}"
    if not got:
        return "no rows"
    return None


def main() -> None:
    from replylens.plans import load_all
    from replylens.plans.registry import QUERIES, SQL
    from replylens.session import build_session
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0] == "--sf":
        sf = "/root/testdata/" + args[1]
        args = args[2:]
    load_all()
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = []
    for name, fn in QUERIES.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        started = time.time()
        try:
            if name in SQL:
                diff = difference(spark, con, sf, fn, SQL[name])
            else:
                diff = None if fn(spark, sf).count() else "no rows"
        except Exception as exc:
            diff = f"{type(exc).__name__}: {str(exc)[:1200]}"
        kind = "sql " if name in SQL else "rows"
        print(f"{'ok  ' if diff is None else 'FAIL'} {kind} {time.time() - started:6.1f}s {name}"
              + (f"\n     {diff}" if diff else ""), flush=True)
        if diff:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
