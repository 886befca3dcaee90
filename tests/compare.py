"""Side-by-side comparison of a query with its SQL, as the driver does it (columns sorted by name)."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def _key(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{type(value).__name__}:{value!r}"


def normalise(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def differences(spark_df, connection, sql: str, limit: int = 3) -> list[str]:
    """Empty when both sides agree on columns, row count and every value."""
    columns = spark_df.columns
    mine = normalise(columns, [tuple(r) for r in spark_df.collect()])
    cursor = connection.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    theirs = normalise(expected_columns, cursor.fetchall())
    if sorted(columns) != sorted(expected_columns):
        return [f"columns {sorted(columns)} != {sorted(expected_columns)}"]
    if len(mine) != len(theirs):
        extra = [r for r in mine if r not in set(theirs)][:limit] + [r for r in theirs if r not in set(mine)][:limit]
        return [f"rows {len(mine)} != {len(theirs)}: {extra}"]
    return [f"{m} != {t}" for m, t in zip(mine, theirs) if m != t][:limit]
