"""Sinks for results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame,
    target: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    as_table: bool = False,
) -> None:
    """Write a result to a path, or to a catalog table with ``as_table``.

    Rows are shuffled by the partition columns first, with adaptive splitting of large ones, so a
    partition is written as a few full files instead of one small file per task.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if as_table:
        writer.saveAsTable(target)
    else:
        writer.save(target)
