"""Compares a query with its SQL in DuckDB, as the driver does."""

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(result):
    return sorted((tuple(map(plain, r)) for r in result), key=repr)


def compare(spark, con, run, sql, folder):
    df = run(spark, folder)
    names = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == names
    assert rows(df.select(*names).collect()) == rows(want.select(*[f'"{n}"' for n in names]).fetchall())
