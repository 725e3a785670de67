"""Compares a query with its SQL in DuckDB over the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    want = con.sql(sql).df()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda d: sorted(tuple("null" if v is None or pd.isna(v) else repr(v.item() if hasattr(v, "item") else v) if not isinstance(v, (int, float)) else repr(float(v)) for v in row) for row in d[cols].astype(object).itertuples(index=False))
    assert key(got) == key(want)
