"""Compares a Spark result with DuckDB's for the same tables."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float | np.floating) and np.isnan(x)):
            return None
        if isinstance(x, float | np.floating):
            return round(float(x), 6)
        return x.item() if hasattr(x, "item") else x

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def agree(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
