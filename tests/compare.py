"""Runs a query and its SQL on the same tables and compares rows without regard to order."""

from pathlib import Path

import duckdb


def tables(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "item"):
        return value.item()
    return tuple(map(_plain, value)) if isinstance(value, list) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in found), key=repr)


def both(spark, sf_dir: str, query, sql: str):
    df = query(spark, sf_dir)
    left = rows(df.columns, df.collect())
    got = tables(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    return left, rows(names, got.fetchall())
