"""Compares queries with their SQL twins on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        source = path if path.is_file() else path / "*.parquet"
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return db


def canonical(value):
    if value is None or value is False or value is True:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else ("f", f"{value + 0.0:.11g}")
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([canonical(row[k]) for k in order] for row in rows), key=repr)


def difference(df, sql: str, folder: str) -> str | None:
    """None if both give the same rows, else what differs."""
    found = db = None
    found = df.collect()
    db = connect(folder).execute(sql)
    names = [d[0] for d in db.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    mine, theirs = rows_of(df.columns, found), rows_of(names, db.fetchall())
    if mine == theirs:
        return None
    a, b = {repr(r) for r in mine}, {repr(r) for r in theirs}
    return f"{len(mine)} rows and {len(theirs)}; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
