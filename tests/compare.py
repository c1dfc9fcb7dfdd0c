"""Holds a query's rows against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"create view {t} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    plain = lambda v: None if pd.api.types.is_scalar(v) and pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(str(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


def same(spark, sf: str, name: str, query, sql: str) -> None:
    got, want = query(spark, sf).toPandas(), connect(sf).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), name
    assert rows(got) == rows(want), name
