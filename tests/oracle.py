"""Comparison of a query with its SQL on the same tables, as the driver does it."""

from pathlib import Path

import duckdb
import pandas as pd


def _canon(df, cols):
    out = []
    for row in df[cols].itertuples(index=False, name=None):
        out.append(tuple("null" if v is None or pd.isna(v) is True else f"{v:.9g}" if isinstance(v, float) else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v) for v in row))
    return sorted(out)


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert _canon(got, cols) == _canon(want, cols)
