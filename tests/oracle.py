"""Runs registered queries against DuckDB on the same parquet files and compares every value."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    """Return (row count, None) when equal, else (row count, first difference)."""
    cols, got = _canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    types = dict(zip(rel.columns, map(str, rel.types)))
    want_cols, want = _canonical(rel.columns, rel.fetchall())
    if cols != want_cols:
        return len(got), f"columns {cols} != {want_cols}"
    if any(t == "HUGEINT" for t in types.values()):
        return len(got), f"HUGEINT in {types}"
    if len(got) != len(want):
        missing = [r for r in want if r not in set(got)][:2] if len(want) < 200000 else []
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 200000 else []
        return len(got), f"rows {len(got)} != {len(want)}; missing {missing}; extra {extra}"
    for g, w in zip(got, want):
        if repr(g) != repr(w):
            return len(got), f"{cols}: {g} != {w}"
    return len(got), None
