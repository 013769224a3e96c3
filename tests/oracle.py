"""DuckDB views over the test tables, and rows of two results in a common form."""

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if isinstance(v, bool) else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted([tuple(map(plain, r)) for r in df[cols].itertuples(index=False, name=None)], key=repr)
