"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import math
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from shiftlab_checks.oracles import ORACLES
from shiftlab_checks.queries import QUERIES


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    """A DuckDB connection with the driver tables of a folder as views."""
    connection = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value if value is None or isinstance(value, (int, str, bool)) else str(value)


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, connection, folder: str, name: str) -> dict:
    """Row counts, columns and the first differing rows of one query."""
    started = time.time()
    result = QUERIES[name](spark, folder)
    rows = [tuple(row) for row in result.collect()]
    seconds = time.time() - started
    cursor = connection.execute(ORACLES[name])
    expected_columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    ours, theirs = _bag(result.columns, rows), _bag(expected_columns, expected)
    return {
        "name": name,
        "seconds": round(seconds, 2),
        "rows": len(rows),
        "expected_rows": len(expected),
        "columns_match": sorted(result.columns) == sorted(expected_columns),
        "match": ours == theirs and sorted(result.columns) == sorted(expected_columns),
        "extra": list((ours - theirs).items())[:3],
        "missing": list((theirs - ours).items())[:3],
    }
