"""Runs a query and its SQL on the same tables and compares the rows."""

import glob
import os
from decimal import Decimal

import duckdb


def connect(root):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{root}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 6)
    return round(float(x), 6) if isinstance(x, Decimal) else x


def compare(spark, root, db, run, sql):
    df = run(spark, root)
    columns = sorted(df.columns)
    want = db.sql(sql)
    assert sorted(want.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=str)
    assert got == sorted((tuple(plain(x) for x in r) for r in db.sql(f"SELECT {names} FROM ({sql})").fetchall()), key=str)
