"""Run a query and its oracle SQL over the same tables and compare rows without order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def plain(value):
    """A form of a value that both engines share; floats keep nine digits."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        number = float(value)
        return "nan" if math.isnan(number) else f"{number:.9g}"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 1 << 52 else str(value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(sorted((str(k), plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    frame = query(spark, sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    ours, theirs = rows_of(frame.columns, frame.collect()), rows_of(names, result.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} and {b}"
    return ""
