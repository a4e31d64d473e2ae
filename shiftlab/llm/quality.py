"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages (fixed-length windows of its UTF-8 bytes). Every passage is encoded:
frequencies of hashed byte pairs, how full it is and how much it repeats itself, then a learned layer. Gated attention, learned from document labels
alone, weighs the passages; the weighted mean of their encodings is scored by a logistic output.

Training reads a bounded sample: about ``TRAIN_TEXTS`` labelled documents, fewer if these hold more
than ``SAMPLE_BYTES`` of text, with every passage of each. Scoring reads every passage of every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm.common import blank, held_out, staged, text_batches, text_udf
from shiftlab.llm.windows import Adam, bounded_texts, labelled_windows, sample_labels, windows

PASSAGE = 512
PAIRS = 512
LAGS = range(2, 25)  # distances at which a passage is compared with itself
FEATURES = PAIRS + 3
HIDDEN = 24
ATTENTION = 12
TRAIN_TEXTS = 5_000
EPOCHS = 8
BATCH = 64
RATE = 0.004
FOLDS, HELD_OUT_FOLD = 3, 1


def pair_buckets() -> np.ndarray:
    """The feature of every pair of bytes; pairs with the filling byte 0 have none (feature 0)."""
    pairs = np.arange(65536, dtype=np.uint64)
    mixed = (pairs + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    buckets = (mixed >> np.uint64(40)) % np.uint64(PAIRS - 1) + np.uint64(1)
    return np.where((pairs < 256) | (pairs % 256 == 0), 0, buckets).astype(np.int32)


def encode(grid: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Features of passages, shape (passages, FEATURES): roots of the pairs' shares, fill, repetition."""
    index = buckets.take(grid[:, :-1].astype(np.uint16) * 256 + grid[:, 1:])
    index += (np.arange(len(grid), dtype=np.int32) * PAIRS)[:, None]
    counts = np.bincount(index.ravel(), minlength=len(grid) * PAIRS).reshape(-1, PAIRS).astype(np.float32)
    counts[:, 0] = 0
    used = np.maximum(np.count_nonzero(grid, axis=1), 1)
    same = np.zeros((len(LAGS), len(grid)), np.float32)
    for k, lag in enumerate(LAGS):
        same[k] = np.count_nonzero((grid[:, lag:] == grid[:, :-lag]) & (grid[:, lag:] != 0), axis=1) / used
    extra = np.stack([used / PASSAGE, 1 / np.sqrt(used), same.max(axis=0)], axis=1)
    return np.concatenate([np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)), extra], axis=1, dtype=np.float32)


@dataclass(frozen=True)
class BagModel:
    params: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of the positive label for consecutive bags of ``counts`` passages."""
        return _forward(self.params, x, np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)["score"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["w"] + p["b"])
    t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    e = (t * g) @ p["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
    share = e / np.repeat(np.add.reduceat(e, starts), counts)
    z = np.add.reduceat(share[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "g": g, "share": share, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    f = _forward(p, x, starts, counts)
    error = ((f["score"] - y) * weight / len(y)).astype(np.float32)
    dz = np.repeat(error[:, None] * p["c"][None], counts, axis=0)
    dshare = (dz * f["h"]).sum(axis=1)
    de = f["share"] * (dshare - np.repeat(np.add.reduceat(f["share"] * dshare, starts), counts))
    dt = de[:, None] * p["a"][None] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * p["a"][None] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["share"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
    return {
        "w": x.T @ dh, "b": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg,
        "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ error, "d": error.sum(keepdims=True),
    }


def train(labels: np.ndarray, grids: list[np.ndarray], seed: int = 5) -> BagModel:
    """A model from document labels (0 or 1) and each document's passages; without any, scores are 0.5."""
    rng = np.random.default_rng(seed)
    shapes = {"w": (FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN,), "d": (1,)}
    p = {k: (rng.normal(0, s[0] ** -0.5, s) * (len(s) > 1 or k in "ac")).astype(np.float32) for k, s in shapes.items()}
    p["w"] *= 4  # features are small
    if not len(labels):
        return BagModel({k: np.zeros_like(v) for k, v in p.items()})
    y, buckets, steps = np.asarray(labels, np.float32), pair_buckets(), Adam(p, RATE)
    # Both labels weigh the same, however rare one of them is.
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate)).astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x = encode(np.concatenate([grids[i] for i in rows]), buckets)
            steps.update(_gradients(p, x, np.array([len(grids[i]) for i in rows]), y[rows], weight[rows]))
    return BagModel(p)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", bound: int = TRAIN_TEXTS) -> BagModel:
    """A model learned from the labels outside the held-out fold. Labels of no document are ignored."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(doc_id, FOLDS, HELD_OUT_FOLD))
    known = known.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    # Drawn per label, so that a rare one is learned, and of labels that have a document.
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    own = sample_labels(staged(known.join(ids, "doc_id", "left_semi"), "known-labels"), "doc_id", "label", bound)
    texts = docs.select(F.col(doc_id).alias("doc_id"), blank(text).alias("text"))
    # The sample is bounded, so it may be sent to every executor.
    sampled = bounded_texts(texts.join(F.broadcast(own), "doc_id"), "doc_id", "text", label="label")
    frame = labelled_windows(sampled, "text", "label", PASSAGE)
    return train(frame["label"].to_numpy(), [np.frombuffer(b, np.uint8).reshape(-1, PASSAGE) for b in frame["bytes"]])


def with_quality(docs: DataFrame, model: BagModel, name: str, text: str = "text") -> DataFrame:
    """``docs`` with the quality score (0 to 1) in a column ``name``; NULL texts score as empty ones."""

    def build():
        buckets = pair_buckets()

        def score(texts: list[str]) -> np.ndarray:
            grid, counts = windows(texts, PASSAGE)
            x = np.concatenate([encode(grid[a : a + 2048], buckets) for a in range(0, len(grid), 2048)])
            return model.scores(x, counts)[:, None]

        return score

    text_batches(docs.sparkSession)
    return docs.withColumn(name, text_udf(build, 1)(blank(text))[0])


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; other columns are ignored.

    Repeated rows are scored each, equal texts equally; an empty labels table gives scores of 0.5.
    """
    model = fit(docs, labels)
    own = docs.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT_FOLD).alias("held_out"), "text")
    return with_quality(own, model, "score").drop("text").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
