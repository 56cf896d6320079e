"""Running a query and its SQL side by side on the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in a fixed order, values as text."""
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        column = frame[name]
        if str(column.dtype).startswith("datetime"):
            column = column.dt.strftime("%Y-%m-%d %H:%M:%S.%f")
        elif column.dtype.kind == "f":
            column = column.map(lambda value: "null" if pd.isna(value) else f"{value:.9g}")
        else:
            column = column.map(lambda value: "null" if value is None or value is pd.NA or value != value else str(value))
        frame[name] = column.astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """What is wrong, or None."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    kinds = [(name, ours[name].dtype.kind, theirs[name].dtype.kind) for name in ours.columns]
    wrong = [kind for kind in kinds if kind[1] != kind[2] and len(ours)]
    if wrong:
        return f"types {wrong}"
    ours, theirs = normal(ours), normal(theirs)
    if not ours.equals(theirs):
        where = (ours != theirs).any(axis=1)
        return f"{int(where.sum())} rows differ, first:\n{ours[where].head(3)}\n{theirs[where].head(3)}"
    return None
