"""Order-free comparison of a Spark result with the DuckDB oracle."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _norm(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if str(pdf[c].dtype).startswith("datetime"):
            pdf[c] = pdf[c].astype("datetime64[us]")
    text = pdf.astype(object).where(pdf.notna(), None).map(lambda v: repr(float(v)) if hasattr(v, "__float__") and not isinstance(v, str) else str(v))
    order = text.sort_values(list(text.columns)).index if len(text.columns) else text.index
    return text.loc[order].reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when equal, else a short description."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if not len(got):
        return ""
    kinds = [
        (c, got[c].dtype.kind, want[c].dtype.kind)
        for c in got.columns
        if {got[c].dtype.kind, want[c].dtype.kind} in ({"i", "f"}, {"O", "f"}, {"O", "i"}, {"O", "b"})
    ]
    a, b = _norm(got), _norm(want)
    bad = [c for c in a.columns if not a[c].equals(b[c])]
    if bad:
        c = bad[0]
        i = (a[c] != b[c]).idxmax()
        return f"values differ in {bad}: row {i} {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return f"kinds {kinds}" if kinds else ""
