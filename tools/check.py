"""Run registered queries on Spark and their SQL on DuckDB over the same tables, and compare.

Usage: python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from pulsegrid.queries import load_all  # noqa: E402
from pulsegrid.session import build_session  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session("local[8]", **{"spark__sql__shuffle__partitions": "8",
                                         "spark__ui__enabled": "false",
                                         "spark__ui__showConsoleProgress": "false",
                                         "spark__driver__memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{args.sf}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    registry = load_all()
    bad = 0
    for name, q in registry.items():
        if args.names and not any(name == n or n in q.ids for n in args.names):
            continue
        try:
            t = time.time()
            df = q.run(spark, args.sf)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - t
            if q.sql is None:
                print(f"rows  {name:34s} {len(got):7d} {took:6.2f}s")
                continue
            t = time.time()
            cur = con.execute(q.sql)
            names = [c[0] for c in cur.description]
            want = cur.fetchall()
            sql_took = time.time() - t
            if sorted(names) != sorted(df.columns):
                raise AssertionError(f"columns {sorted(df.columns)} vs {sorted(names)}")
            a, b = rows_of(df.columns, got), rows_of(names, want)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                raise AssertionError(f"{len(a)} vs {len(b)} rows; first differences {diff}")
            print(f"match {name:34s} {len(got):7d} {took:6.2f}s sql {sql_took:.2f}s", flush=True)
        except Exception as exc:  # keep going: report every failing query
            bad += 1
            print(f"FAIL  {name}: {str(exc)[:900]}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
