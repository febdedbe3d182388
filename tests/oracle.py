"""Spark rows against DuckDB rows, by column name and in any order."""

import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def _row(r) -> tuple:
    return tuple(round(x, 6) if isinstance(x, float) else x for x in r)


def _key(r) -> tuple:
    return tuple((x is None, str(type(x)), x) for x in r)


def same(df, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    got = sorted((_row(r[x] for x in columns) for r in df.collect()), key=_key)
    result = c.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(x) for x in columns]
    assert got == sorted((_row(r[i] for i in at) for r in result.fetchall()), key=_key)
