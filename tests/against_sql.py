"""Registered queries held against their SQL in DuckDB, as sorted rows."""

import math
import os

import duckdb


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def same_rows(spark, sf_dir, query, sql):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    got = query(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    a, b = rows_of(got.columns, got.collect()), rows_of(names, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
