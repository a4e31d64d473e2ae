"""What several of the text operators share: reading tables, batches of text, clash-free column names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.operators.scale import staged

__all__ = ["arrow_rows", "blank", "fresh", "held_out", "iterate_texts", "read_table", "staged", "text_batches", "text_udf"]

# Texts are handed to numpy code in slices of about this many characters, so that a batch of very
# long documents needs no more memory than one of short ones.
SLICE_CHARS = 4_000_000
BATCH_BYTES = 4_000_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder, through Spark's own reader (the folder may be in any store Spark reads)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Have Spark bound the batches it hands to Python by their bytes, not by their rows alone.

    Whole texts are long: ten thousand of them at a time, the default made for numbers, would have a
    worker hold tens of megabytes of text several times over. Batches of numbers stay as they are; a
    smaller bound that a user has set stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > size:
        spark.conf.set(name, str(size))


def blank(column: str = "text") -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    return stem if stem.lower() not in taken else f"{stem}_{uuid.uuid4().hex[:8]}"


def arrow_rows(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows as a batch. Ids come through Arrow as they are: pandas would turn long ones beside a NULL into doubles."""
    columns = zip(*rows) if rows else ([] for _ in types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether the document belongs to the fold kept from training; a NULL id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def iterate_texts(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices of about ``limit`` characters; a longer text is a slice of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_udf(build: Callable[[], Callable[[list[str]], np.ndarray]], width: int):
    """A vectorised column function from text to ``width`` doubles per row.

    ``build`` runs once per task and returns the function of a list of texts (NULL came in as an
    empty text) to an array of shape (texts, width).
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = build()
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            parts = [score(texts[a:b]) for a, b in iterate_texts(texts)]
            rows = np.concatenate(parts) if parts else np.empty((0, width))
            yield pd.Series(list(rows.astype(np.float64)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))
