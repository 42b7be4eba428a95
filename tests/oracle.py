"""Compares a query with its SQL in DuckDB: columns by name, rows as a multiset."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(f"{sf_dir}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return con


def differences(df, sql, sf_dir):
    cursor = connect(sf_dir).execute(sql)
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(columns), (sorted(df.columns), sorted(columns))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want), (len(got), len(want))
    return [(g, w) for g, w in zip(got, want) if g != w]
