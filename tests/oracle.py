"""Comparison of a query with its SQL in DuckDB: columns, and rows as a bag."""

import glob
import os
from collections import Counter

import duckdb


def cell(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    return str(v)


def compare(df, sql, folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = c.execute(sql)
    names = [x[0] for x in want.description]
    rows = want.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = Counter(tuple(cell(r[k]) for k in order) for r in df.collect())
    exp = Counter(tuple(cell(dict(zip(names, r))[k]) for k in order) for r in rows)
    assert got == exp, (list((got - exp).items())[:3], list((exp - got).items())[:3])
