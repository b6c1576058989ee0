"""Compare a query's rows with its SQL on the same parquet tables."""

import datetime
import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "asDict"):
        return plain(list(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    return str(v)


def duck_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{path if path.is_file() else path / '*.parquet'}'")
    got = con.sql(sql)
    return list(got.columns), got.fetchall()


def same_rows(df, sf_dir, sql):
    columns, expected = duck_rows(sf_dir, sql)
    names = sorted(df.columns)
    assert sorted(columns) == names
    place = [columns.index(c) for c in names]
    want = sorted(tuple(plain(r[i]) for i in place) for r in expected)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert len(got) == len(want)
    assert got == want
