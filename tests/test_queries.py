"""Every registered query against its SQL on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from pulsegrid.queries import load_all

REGISTRY = load_all()


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_matches_sql(name, spark, sf_dir, duck):
    q = REGISTRY[name]
    df = q.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(q.sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if not q.sql])
def test_runs_without_sql(name, spark, sf_dir):
    assert REGISTRY[name].run(spark, sf_dir).count() > 0
