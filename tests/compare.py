"""Comparison of a Spark result with DuckDB's answer to the same question."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder):
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return ("nan",)
    if isinstance(value, bool):
        return ("bool", value)
    if value is None:
        return ("null",)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return ("number", float(value))
    return (type(value).__name__, value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, connection, sql, limit=3):
    """Empty when both sides agree; otherwise what differs."""
    expected = connection.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    wanted = _rows(names, expected.fetchall())
    found = _rows(df.columns, [tuple(r) for r in df.collect()])
    if not wanted:
        return ["the SQL returns no rows"]
    if len(wanted) != len(found):
        return [f"{len(found)} rows != {len(wanted)}"]
    return [f"{a} != {b}" for a, b in zip(found, wanted) if a != b][:limit]
