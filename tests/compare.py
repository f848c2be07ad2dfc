"""Compare a registered query with its SQL check, value by value."""
from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def differences(df, con, sql: str, limit: int = 3) -> list[str]:
    """Human-readable differences; empty when both sides agree exactly."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = _sorted_rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    found = _sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    if len(found) != len(expected):
        return [f"rows {len(found)} vs {len(expected)}"]
    bad = [f"{f} vs {e}" for f, e in zip(found, expected) if f != e]
    return [f"{len(bad)} of {len(found)} rows differ", *bad[:limit]] if bad else []
