"""Rows of Spark and DuckDB in a form that can be compared."""

import numbers

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, numbers.Number):
        return str(v) if isinstance(v, int) else f"{float(v):.9g}"
    return str(v)


def _sorted(rows):
    return sorted(tuple(map(_plain, r)) for r in rows)


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got = _sorted(df.select(*(f"`{c}`" for c in columns)).collect())
    assert got == _sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
