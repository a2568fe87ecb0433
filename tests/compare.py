"""Rows of a query against rows of its SQL, without regard to order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def value(v) -> str:
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "~"
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    # columns of whole numbers with nulls come as floats from one side only
    for c in df.columns:
        if df[c].dtype.kind == "f" and (df[c].dropna() % 1 == 0).all():
            df = df.assign(**{c: df[c].astype("Int64")})
    return sorted(tuple(map(value, r)) for r in df.astype(object).itertuples(index=False))
