"""Runs a query and its SQL on the same tables and compares the rows, columns by name."""

import math
import os
from glob import glob

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder=SF):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return "null" if v is None else str(v)


def same(rows, columns, other, other_columns):
    assert sorted(columns) == sorted(other_columns)
    order = sorted(columns)
    pick = lambda rs, cs: sorted("|".join(plain(r[cs.index(c)]) for c in order) for r in rs)
    return pick(rows, columns) == pick(other, other_columns)


def check(spark, name, query, sql, folder=SF):
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(rows)
    r = connect(folder).execute(sql)
    names = [x[0] for x in r.description]
    assert same(rows, df.columns, r.fetchall(), names), name
    return len(rows)
