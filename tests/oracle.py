"""Comparison of a Spark result with a DuckDB result: sorted columns, sorted rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(x):
        return round(x, 9) if isinstance(x, float) else x

    return [columns[k] for k in order], sorted([tuple(plain(r[k]) for k in order) for r in rows], key=repr)


def assert_same(df, con, sql):
    found = con.sql(sql)
    want_columns, want = rows_of(found.columns, found.fetchall())
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert columns == want_columns
    assert got == want
