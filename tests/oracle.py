"""Runs a query on Spark and its SQL on DuckDB and compares their rows."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "tolist"):
        return value(v.tolist())
    if isinstance(v, (list, tuple)):
        return str([value(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    return int(v) if isinstance(v, bool) else v


def rows(df):
    df = df[sorted(df.columns)]
    out = [tuple(value(v) for v in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(out, key=lambda r: [(x is not None, str(type(x)) if isinstance(x, str) else "", str(x)) for x in r])


def same(found, expected):
    assert sorted(found.columns) == sorted(expected.columns)
    a, b = rows(found), rows(expected)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert [str(float(v)) if isinstance(v, (int, float)) else str(v) for v in x] == [str(float(v)) if isinstance(v, (int, float)) else str(v) for v in y]
