"""Runs a query and its SQL side by side."""

import os

import duckdb

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, fn, sql, folder=DIR):
    df = fn(spark, folder)
    cols = sorted(df.columns)
    ours = sorted(tuple("" if v is None else repr(v) for v in r) for r in df.select(*cols).collect())
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted(tuple("" if r[i] is None else repr(r[i]) for i in at) for r in rel.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
