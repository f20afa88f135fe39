"""Compare a Spark result with DuckDB's: schema kinds, row count and values, order ignored."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from tabwright.catalog.registry import TABLES

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<float>": "FLOAT[]",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(names, order, rows):
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """What differs, as short texts; empty when equal."""
    found = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in found.description}
    ours = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    problems = []
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} / {sorted(theirs)}"]
    for name, kind in ours.items():
        if KINDS.get(kind, kind) != theirs[name]:
            problems.append(f"type of {name}: {kind} / {theirs[name]}")
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    expected = _rows(names, order, found.fetchall())
    columns = df.columns
    mine = sorted(range(len(columns)), key=lambda i: columns[i])
    actual = _rows(columns, mine, df.collect())
    if actual != expected:
        only_ours, only_theirs = actual - expected, expected - actual
        problems.append(f"rows {sum(actual.values())} / {sum(expected.values())}; "
                        f"{sum(only_ours.values())} only in Spark, e.g. {list(only_ours)[:3]}; "
                        f"{sum(only_theirs.values())} only in SQL, e.g. {list(only_theirs)[:3]}")
    return problems
