"""Comparing a query with its SQL over the same tables."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def views(folder=DATA):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v if isinstance(v, (bool, int, str)) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark, name, query, sql, folder=DATA):
    got = query(spark, folder)
    found = views(folder).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns), name
    want = rows_of(names, found.fetchall())
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want, name
