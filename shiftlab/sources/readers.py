"""Readers: catalog tables, files of any Spark format, and comparison rows as CSV."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlab.sources.schemas import COMPARISON_SCHEMA, SCHEMAS


def read_source(
    spark: SparkSession,
    name: str,
    location: str,
    fmt: str = "table",
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """A source table with the columns the operators expect, and no others.

    ``location`` is a catalog name for ``fmt="table"``, else a path. ``columns`` maps expected
    names to the warehouse's own names or to SQL expressions over them. Types are cast only where
    they differ, so filters on matching columns still reach the scan.
    """
    raw = spark.table(location) if fmt == "table" else spark.read.format(fmt).load(location)
    columns = columns or {}
    expected = SCHEMAS[name]
    named = raw.select(
        *[F.expr(columns.get(f.name, f"`{f.name}`")).alias(f.name) for f in expected]
    )
    casts = {
        f.name: F.col(f.name).cast(f.dataType)
        for f, given in zip(expected, named.schema, strict=True)
        if given.dataType != f.dataType
    }
    return named.withColumns(casts) if casts else named


def read_sources(
    spark: SparkSession,
    locations: Mapping[str, str],
    fmt: str = "table",
    columns: Mapping[str, Mapping[str, str]] | None = None,
) -> dict[str, DataFrame]:
    """Several sources at once, as the ``tables`` argument of the plans."""
    columns = columns or {}
    return {
        name: read_source(spark, name, location, fmt, columns.get(name))
        for name, location in locations.items()
    }


def comparison_rows_from_text(spark: SparkSession, text: str) -> DataFrame:
    """Comparison rows from CSV text with a header line; ``ordinal`` keeps the line order.

    For inline text: one task parses it. Read larger inputs with ``read_comparison_csv``.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in COMPARISON_SCHEMA)
    body = text.strip().split("\n", 1)[1]
    lines = spark.range(1).select(
        F.posexplode(F.split(F.lit(body), "\r?\n")).alias("ordinal", "line")
    )
    return lines.filter(F.trim("line") != "").select(
        "ordinal", F.from_csv("line", schema).alias("row")
    ).select("ordinal", "row.*")


def read_comparison_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comparison rows from one UTF-8 CSV file with a header; ``ordinal`` follows the line order."""
    rows = spark.read.schema(COMPARISON_SCHEMA).csv(
        path, header=True, encoding="UTF-8", enforceSchema=False
    )
    return rows.select(F.monotonically_increasing_id().alias("ordinal"), "*")
