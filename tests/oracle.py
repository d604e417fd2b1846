"""Holds a query against SQL that tells the same."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    names = sorted(got.columns)
    assert sorted(df.columns) == names
    at = [got.columns.index(c) for c in names]
    want = sorted(str([plain(r[i]) for i in at]) for r in got.fetchall())
    assert sorted(str([plain(v) for v in r]) for r in df.select(*names).collect()) == want
