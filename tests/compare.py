"""Comparison of a Spark result with DuckDB's result of the query's SQL."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb


def connect(directory: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{directory}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return [_plain(item) for item in value]
    if isinstance(value, dict):
        return {key: _plain(item) for key, item in value.items()}
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def differences(frame, connection, sql: str) -> list[str]:
    """What differs between the two results; nothing if they are equal bit for bit."""
    mine_columns, mine = _sorted_rows(frame.columns, [tuple(row) for row in frame.collect()])
    answer = connection.execute(sql)
    names = [entry[0] for entry in answer.description]
    their_columns, theirs = _sorted_rows(names, answer.fetchall())
    found = []
    if mine_columns != their_columns:
        found.append(f"columns {mine_columns} != {their_columns}")
    if len(mine) != len(theirs):
        found.append(f"{len(mine)} rows != {len(theirs)} rows")
    if not found and mine != theirs:
        found += [f"{a} != {b}" for a, b in zip(mine, theirs) if a != b][:3]
    if not found and not theirs:
        found.append("EMPTY")
    return found
