"""Schemas, readers and sinks."""

from shiftlab.sources.readers import (
    comparison_rows_from_text,
    read_comparison_csv,
    read_source,
    read_sources,
)
from shiftlab.sources.schemas import COMPARISON_SCHEMA, SCHEMAS
from shiftlab.sources.sinks import write_table

__all__ = [
    "COMPARISON_SCHEMA",
    "SCHEMAS",
    "comparison_rows_from_text",
    "read_comparison_csv",
    "read_source",
    "read_sources",
    "write_table",
]
