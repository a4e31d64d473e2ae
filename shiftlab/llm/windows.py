"""Texts as fixed-length windows of UTF-8 bytes, and bounded samples of labelled windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm.common import fresh, staged

HASH_RANGE = 10**15  # a sample's share of it is never rounded to nothing
SAMPLE_BYTES = 200_000_000  # of sampled texts, which reach the driver whole


def windows(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, shape (windows, length), and how many each text has.

    Consecutive windows cover the whole text; the last one is filled up with zero bytes. An empty
    text has one window of zeros.
    """
    parts, counts = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        counts[i] = max(1, -(-len(data) // length))
        parts.append(data.ljust(int(counts[i]) * length, b"\0"))
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, length), counts


def fold_case(texts: list[str]) -> list[str]:
    return [t.lower() for t in texts]


def sample_rows(rows: DataFrame, key: str, bound: int, salt: str = "sample") -> DataFrame:
    """About ``bound`` of the rows at most, picked by a hash of ``key``: the same ones in every run."""
    share = min(1.0, bound / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(HASH_RANGE)) < int(share * HASH_RANGE))


def sample_labels(rows: DataFrame, key: str, label: str, bound: int, salt: str = "sample") -> DataFrame:
    """About ``bound`` of the rows at most, picked by a hash of ``key``, with rows of every label.

    Half of the bound is dealt to the labels by their numbers of rows and half equally; a label with
    fewer rows than that has all of them, and every label the row whose hash is smallest.
    """
    place = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(HASH_RANGE))
    # One row per label reaches the driver, as labels are what is learned.
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).collect()
    total = sum(r["n"] for r in counts)
    if total <= bound:
        return rows
    ends = []
    for name, n, least in counts:
        share = min(1.0, bound / 2 * (1 / total + 1 / (len(counts) * n)))
        ends.append((name, max(int(share * HASH_RANGE), least + 1)))
    end = fresh(rows, "end")
    limits = rows.sparkSession.createDataFrame(ends, f"{label} {dict(rows.dtypes)[label]}, {end} long")
    return rows.join(F.broadcast(limits), label).where(place < F.col(end)).select(*rows.columns)


def bounded_texts(rows: DataFrame, key: str, text: str, limit: int = SAMPLE_BYTES, label: str | None = None) -> DataFrame:
    """The given (few) rows, or as many of them as hold about ``limit`` bytes of text: whole texts either way.

    With ``label`` every label keeps rows.
    """
    own = staged(rows, "sampled-texts")
    n, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    if size <= limit:
        return own
    bound = max(1, n * limit // size)
    return sample_labels(own, key, label, bound, "bytes") if label else sample_rows(own, key, bound, "bytes")


def labelled_windows(rows: DataFrame, text: str, label: str, length: int, lower: bool = False) -> pd.DataFrame:
    """Of the given (few) rows: label and all windows as bytes, sorted."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for t, y in zip(batch["text"], batch["label"]):
                grid, _ = windows(["" if t is None else t.lower() if lower else t], length)
                found.append((y, grid.tobytes()))
            yield pd.DataFrame(found, columns=["label", "bytes"])

    kind = dict(rows.dtypes)[label]
    cuts = rows.select(F.col(text).alias("text"), F.col(label).alias("label")).mapInPandas(cut, f"label {kind}, bytes binary")
    frame = cuts.toPandas()
    frame["bytes"] = frame["bytes"].map(bytes)
    return frame.sort_values(["label", "bytes"], ignore_index=True)


class Adam:
    """Gradient steps for a dict of numpy arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.step), self.v[k] / (1 - 0.999**self.step)
            self.params[k] -= self.rate * m / (np.sqrt(v) + 1e-8)
