"""Run a query beside its SQL in DuckDB and compare values, column by column name."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, datetime.date | datetime.datetime):
        return v.isoformat()
    if isinstance(v, float):
        return repr(round(v, 9))
    return repr(v)


def same(df, con, sql):
    got_columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in got_columns) for r in df.collect())
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    order = [names.index(c) for c in sorted(names)]
    want = sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    assert got_columns == sorted(names)
    assert got == want
