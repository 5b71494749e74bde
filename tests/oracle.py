"""Rows of a Spark query against rows of its DuckDB SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).fetch_df()


def cell(x):
    if pd.isna(x):
        return None
    if isinstance(x, float):
        return int(x) if x == int(x) else repr(x)
    return x.item() if hasattr(x, "item") else x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=repr)
