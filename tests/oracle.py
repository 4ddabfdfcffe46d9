"""Runs a query on Spark and its SQL on DuckDB, and compares rows and types."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "float": "FLOAT"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).iterdir():
        path = p if p.is_file() else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs; empty if nothing does."""
    found = con.sql(sql)
    types = dict(zip(found.columns, map(str, found.types), strict=True))
    mine = {c: KINDS.get(k, k) for c, k in df.dtypes}
    if set(types) != set(mine):
        return [f"columns {sorted(mine)} against {sorted(types)}"]
    out = [f"{c}: {mine[c]} against {types[c]}" for c in sorted(types) if types[c] != mine[c]]
    order = sorted(types)
    theirs = sorted([tuple(_plain(v) for v in r) for r in con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in order)} FROM ({sql}) t").fetchall()], key=_key)
    ours = sorted([tuple(_plain(r[c]) for c in order) for r in df.collect()], key=_key)
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} rows against {len(theirs)}")
    only_ours, only_theirs = set(ours) - set(theirs), set(theirs) - set(ours)
    if only_ours or only_theirs or (len(ours) == len(theirs) and ours != theirs):
        out.append(f"{len(only_ours)} rows differ: {order}: {sorted(only_ours, key=_key)[:3]} against {sorted(only_theirs, key=_key)[:3]}")
    return out
