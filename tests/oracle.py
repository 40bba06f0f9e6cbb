"""Comparing a query with its SQL on the same tables."""

from __future__ import annotations

import os

import pandas as pd


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


def compare(spark, con, part, name: str, sf_dir: str) -> None:
    ours, theirs = part.QUERIES[name](spark, sf_dir).toPandas(), con.execute(part.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
