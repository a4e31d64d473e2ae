"""Language identification by a convolutional network over bytes.

Byte embeddings, filters of several widths, the maximum of each filter over a window, and a softmax
over the learned languages, trained in numpy. A text is cut into fixed-length windows of its
lower-cased UTF-8 bytes, all of them are scored in batches, and the languages' probabilities are
averaged over the windows by the bytes they hold.

For scoring, embedding and filter weights are multiplied out into one table per pair of adjacent
bytes, so that a filter of width four is the sum of two table rows.

Training reads a bounded sample: about ``TRAIN_TEXTS`` texts of all languages, rare ones included (fewer
if these hold more than ``SAMPLE_BYTES``), with every window of each. All languages weigh the same, but
a window never more than ``MOST_WEIGHT`` times the average.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm.common import blank, fresh, held_out, text_batches, text_udf
from shiftlab.llm.windows import Adam, bounded_texts, fold_case, labelled_windows, sample_labels, windows

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
TRAIN_TEXTS = 5_000
MOST_WEIGHT = 20
EPOCHS = 3  # or as many as make LEAST_STEPS steps
LEAST_STEPS = 400
BATCH = 64
RATE = 0.004
UNKNOWN = "und"
FOLDS, HELD_OUT_FOLD = 4, 2
KEPT = 0.4  # documents are rejected below this probability
SCORE_BATCH = 128


@dataclass(frozen=True)
class ByteNet:
    languages: tuple[str, ...]
    params: dict[str, np.ndarray]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, tables of 65,536 rows (pair of bytes) or 256 rows (last byte of an odd width)."""
        out = []
        for w in WIDTHS:
            single = [self.params["embed"] @ self.params[f"w{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)]
            steps = [(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)]
            out.append([np.ascontiguousarray(t) for t in steps + ([single[-1]] if w % 2 else [])])
        return out


def train(labels: list[str], grids: list[np.ndarray], seed: int = 11) -> ByteNet | None:
    """A network from windows (each item an array (windows, WINDOW) of one label); None without labels."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    x = np.concatenate(grids)
    y = np.repeat([languages.index(v) for v in labels], [len(g) for g in grids])
    p = {"embed": rng.normal(0, 0.5, (256, EMBEDDING)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), "bias": np.zeros(len(languages))}
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    steps = Adam(p, RATE)
    sizes = np.bincount(y, minlength=len(languages))
    weight = np.minimum(len(y) / (len(languages) * np.maximum(sizes, 1)), MOST_WEIGHT)[y].astype(np.float32)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(x)))):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            steps.update(_gradients(p, x[rows], y[rows], weight[rows]))
    return ByteNet(languages, p)


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    embedded, n = p["embed"][x], np.arange(len(x))
    pooled, places = [], []
    for w in WIDTHS:
        seen = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1).transpose(0, 1, 3, 2)
        answers = seen.reshape(len(x), -1, w * EMBEDDING) @ p[f"w{w}"]
        place = answers.argmax(axis=1)
        pooled.append(np.take_along_axis(answers, place[:, None, :], 1)[:, 0] + p[f"b{w}"])
        places.append(place)
    hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
    logits = hidden @ p["out"] + p["bias"]
    error = np.exp(logits - logits.max(axis=1, keepdims=True))
    error /= error.sum(axis=1, keepdims=True)
    error[n, y] -= 1
    error *= weight[:, None] / len(x)
    grads = {"out": hidden.T @ error, "bias": error.sum(axis=0), "embed": np.zeros_like(p["embed"])}
    back = (error @ p["out"].T) * (hidden > 0)
    for k, (w, place) in enumerate(zip(WIDTHS, places)):
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        seen = x[n[:, None, None], place[:, :, None] + np.arange(w)]  # (batch, filters, w) bytes
        patch = p["embed"][seen].reshape(len(x), FILTERS, -1)
        grads[f"w{w}"] = np.einsum("nf,nfd->df", own, patch)
        grads[f"b{w}"] = own.sum(axis=0)
        spread = own[:, :, None] * p[f"w{w}"].T[None]
        np.add.at(grads["embed"], seen.reshape(-1), spread.reshape(-1, EMBEDDING))
    return grads


def probabilities(net: ByteNet, tables: list[list[np.ndarray]], grid: np.ndarray) -> np.ndarray:
    """Softmax of every window, shape (windows, languages)."""
    out = np.empty((len(grid), len(net.languages)), np.float32)
    for at in range(0, len(grid), SCORE_BATCH):
        x = grid[at : at + SCORE_BATCH]
        pairs = x[:, :-1].astype(np.uint16) * 256 + x[:, 1:]
        pooled = []
        for w, steps in zip(WIDTHS, tables):
            span = WINDOW - w + 1
            answers = steps[0].take(pairs[:, :span], axis=0)
            for j, table in enumerate(steps[1:], 1):
                answers += table.take(pairs[:, 2 * j : 2 * j + span] if len(table) > 256 else x[:, 2 * j : 2 * j + span], axis=0)
            pooled.append(answers.max(axis=1) + net.params[f"b{w}"])
        logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.params["out"] + net.params["bias"]
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        out[at : at + SCORE_BATCH] = odds / odds.sum(axis=1, keepdims=True)
    return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = TRAIN_TEXTS) -> ByteNet | None:
    """A network learned from the documents outside the held-out fold that have a language and a text."""
    known = docs.where(F.col(lang).isNotNull() & ~held_out(doc_id, FOLDS, HELD_OUT_FOLD))
    named = known.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    usable = named.where("text is not null and text rlike '\\\\p{L}'")
    sampled = bounded_texts(sample_labels(usable, "doc_id", "lang", bound), "doc_id", "text", label="lang")
    frame = labelled_windows(sampled, "text", "lang", WINDOW, lower=True)
    return train(list(frame["label"]), [np.frombuffer(b, np.uint8).reshape(-1, WINDOW) for b in frame["bytes"]])


def with_language(docs: DataFrame, net: ByteNet | None, lang_name: str, score_name: str, text: str = "text") -> DataFrame:
    """``docs`` with the predicted language and its probability (0 to 1) in two more columns.

    A text that is NULL, empty or without a letter is ``und`` with score 0, and so is every text if
    nothing was learned. Rows, ties and repeated rows pass as they are; equal texts score equally.
    """
    languages = (UNKNOWN, *(net.languages if net else ()))

    def build():
        tables = net.tables() if net else []

        def score(texts: list[str]) -> np.ndarray:
            result = np.zeros((len(texts), 2))
            if net is None:
                return result
            own = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
            if not own:
                return result
            grid, counts = windows(fold_case([texts[i] for i in own]), WINDOW)
            weight = (grid != 0).sum(axis=1, dtype=np.float64) + 1e-6
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            mean = np.add.reduceat(probabilities(net, tables, grid) * weight[:, None], starts, axis=0)
            mean /= np.add.reduceat(weight, starts)[:, None]
            result[own, 0] = mean.argmax(axis=1) + 1
            result[own, 1] = mean.max(axis=1)
            return result

        return score

    text_batches(docs.sparkSession)
    both = fresh(docs, "language_score")
    scored = docs.withColumn(both, text_udf(build, 2)(blank(text)))
    names = F.array(*(F.lit(v) for v in languages))
    return scored.withColumns(
        {
            lang_name: F.element_at(names, F.col(both)[0].cast("int") + 1),
            score_name: F.least(F.col(both)[1], F.lit(1.0)),
        }
    ).drop(both)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; other columns are ignored."""
    net = fit(docs)
    own = docs.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT_FOLD).alias("held_out"), "text")
    return with_language(own, net, "lang_pred", "score").drop("text")


def keep_known(docs: DataFrame, least: float = KEPT) -> DataFrame:
    """The documents, all columns, whose language is recognised with at least the given probability."""
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    known = with_language(docs, fit(docs), lang, score)
    return known.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
