"""Compare registered queries with their SQL on the driver's tables."""

from __future__ import annotations

import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    import pandas as pd

    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return int(x) if x.is_integer() else float(f"{x:.9g}")
    return x


def difference(got, want) -> str:
    """Empty if both frames (pandas) hold the same rows; else what is wrong."""
    a, b = sorted(got.columns), sorted(want.columns)
    if a != b:
        return f"columns {a} and {b}"
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[a].itertuples(index=False, name=None)), key=repr)
    x, y = rows(got), rows(want)
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows"
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else ""
