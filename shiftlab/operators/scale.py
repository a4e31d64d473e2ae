"""Size-checked broadcasts and staged tables.

Plans, not operators, decide what to broadcast: they count a table once and mark it when it fits;
beyond the bound the same join runs as a shuffle join, where adaptive execution splits skewed
partitions. The mark on a lookup table stays with every projection an operator takes of it.

Results that several steps read, or whose size decides a join, are written once to the shared folder
named by ``spark.checkpoint.dir`` and read back: lost executors then cost no recomputation, and the
optimizer plans the rest from exact file sizes. Results are lazy, so only the caller knows when staged
tables are no longer needed: run a study and write its result inside ``staging`` to have them deleted.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Bounds in bytes of a broadcast hash table on every executor.
DIMENSION_BYTES = 20_000_000
SHIFT_BYTES = 100_000_000
MEMBER_BYTES = 150_000_000
# What a row takes there besides its values: pointers, key, lengths.
ROW_BYTES = 48

_local_folders: dict[str, str] = {}
_open_stagings: list[list[str]] = []


def _size(df: DataFrame) -> Column:
    values = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns]
    width = sum((v + F.lit(8) for v in values), F.lit(ROW_BYTES))
    return F.coalesce(F.sum(width), F.lit(0))


def table_bytes(df: DataFrame) -> int:
    """Bytes of ``df`` as a hash table: its values' lengths and a share per row."""
    return df.agg(_size(df)).first()[0]


def fits(df: DataFrame, max_bytes: int) -> bool:
    """Whether ``df`` takes at most ``max_bytes``. Each task reports one number."""
    return table_bytes(df) <= max_bytes


def dimension(df: DataFrame, max_bytes: int = DIMENSION_BYTES) -> DataFrame:
    """``df`` marked for broadcast when it is small enough, otherwise unchanged."""
    return F.broadcast(df) if fits(df, max_bytes) else df


def only_if_fits(df: DataFrame, max_bytes: int = MEMBER_BYTES) -> DataFrame | None:
    """``df`` marked for broadcast, or None when it is too large for that."""
    return F.broadcast(df) if fits(df, max_bytes) else None


def keep_known(df: DataFrame, known: DataFrame | None, on: list[str]) -> DataFrame:
    """Drop rows of a large table whose key is not in ``known``, before they are shuffled.

    Only an early filter: callers still join on the same key later, so without ``known`` (see
    ``only_if_fits``) the table passes unchanged and the result is the same.
    """
    return df if known is None else df.join(known.select(*on), on, "left_semi")


def staging_folder(spark: SparkSession) -> str:
    """The shared folder for staged tables; a local one of its own only on a local master."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="shiftlab-")
    return _local_folders[context.applicationId]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the staging folder and return the written table."""
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _open_stagings:
        _open_stagings[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_dimension(df: DataFrame, name: str, max_bytes: int = DIMENSION_BYTES) -> DataFrame:
    """``staged``, marked for broadcast when it is small enough: it is measured while it is written."""
    seen = Observation()
    out = staged(df.observe(seen, _size(df).alias("bytes")), name)
    return F.broadcast(out) if seen.get["bytes"] <= max_bytes else out


def together(spark: SparkSession, *steps: Callable[[], DataFrame]) -> list[DataFrame]:
    """The results of steps that run jobs and do not need each other, side by side.

    One small job leaves most of a cluster idle; Spark schedules the jobs of several threads at once.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Own the tables staged inside, and delete them at the end.

    Results that read them have to be written or collected before.
    """
    _open_stagings.append([])
    try:
        yield
    finally:
        for path in _open_stagings.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
