"""Runs a registered query and its SQL on the same tables, and compares all rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connection(sf: str = SF):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if kind == "object" or kind.startswith(("str", "datetime")):
            df[c] = df[c].map(lambda v: str(v.tolist()) if hasattr(v, "tolist") else str(v))
        elif kind != "bool":
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(found: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(expected.columns)
    pd.testing.assert_frame_equal(normal(found), normal(expected), check_dtype=False, rtol=0, atol=1e-9)
