"""Benchmark decontamination by q-gram lemma filtering.

Documents and benchmark items are compared as lower-cased letters and digits with single separators.
Of an item with n characters found with at most k edits, at least (n - q + 1) - k * q of its q-grams
remain, and the diagonals (document position minus item position) of those that remain differ by at
most k. So shared q-grams are counted in bands of diagonals that are 2 * (k + 1) wide and overlap by
half; a band below the bound cannot hold a match. Bands that reach it are verified by a banded
alignment of the item with that region of the document. Before q-grams are looked up at all, regions
are left out in which fewer positions than the bound have any q-gram of the benchmark.

Items under ``LEAST_CHARS`` characters, too short to tell an edit from another word, are searched as
they are: between separators, by a hash of every run of that many characters that begins and ends with
a word, and then character by character.

Items longer than ``SEGMENT`` are searched by overlapping segments, so that half of a long item is
found too. The index of the items is sent to all executors in blocks of at most about
``BLOCK_CHARS`` characters, one pass over the documents per block: its size is bounded whatever the
size of the benchmark. Documents are neither shuffled nor cut.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shiftlab.llm.common import arrow_rows, blank, iterate_texts, text_batches

Q = 8
EDIT_SHARE = 0.05
LEAST_CHARS = 32
SEGMENT = 160
BLOCK_CHARS = 1_000_000
FILTER_BITS = 22
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32


def fold_table() -> np.ndarray:
    """For each 16-bit code point its lower case, or a space if it is no letter or digit."""
    low = [c.lower() for c in map(chr, range(65536))]
    return np.array([ord(c) if len(c) == 1 and c.isalnum() else SPACE for c in low], np.uint32)


def normalise(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters with single separators, and the place of each in the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    wide = points > 0xFFFF
    folded = table.take(np.where(wide, 0, points))
    folded[wide] = points[wide]
    keep = folded != SPACE
    keep[1:] |= keep[:-1]  # the first separator after a letter or digit
    places = np.flatnonzero(keep)
    return folded[places], places


def grams(chars: np.ndarray) -> np.ndarray:
    """The q-grams as 64-bit integers, eight bits a character; different ones seldom look alike."""
    small = np.ascontiguousarray(((chars ^ (chars >> 8) ^ (chars >> 16)) & 0xFF).astype(np.uint8))
    if len(small) < Q:
        return np.empty(0, np.uint64)
    return np.lib.stride_tricks.as_strided(small.view(np.uint8), (len(small) - Q + 1, Q), (1, 1)).copy().view("<u8")[:, 0]


@dataclass(frozen=True)
class Index:
    """Segments of benchmark items and their q-grams, sorted."""

    items: list
    segments: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    segment: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    # Of items too short for q-grams, by their length: sorted hashes, and the items with their characters.
    short: dict[int, tuple[np.ndarray, list[list[tuple[object, np.ndarray]]]]]

    def classes(self) -> list[tuple[int, int]]:
        """(Longest match, least shared q-grams) of the segments, by classes of similar length."""
        size = np.array([len(s) for s in self.segments], np.int64)
        out = []
        for group in np.unique(size // 16):
            own = size // 16 == group
            out.append((int((size + self.budget)[own].max()), int(self.least[own].min())))
        return out


def dense(hits: np.ndarray, classes: list[tuple[int, int]]) -> np.ndarray:
    """Positions inside some window of a class's length that has the class's least number of hits."""
    total = np.concatenate([[0], np.cumsum(hits, dtype=np.int32)])
    edges = np.zeros(len(hits) + 1, np.int32)
    for length, least in classes:
        w = min(length, len(hits))
        starts = np.flatnonzero(total[w:] - total[:-w] >= least)
        edges += np.bincount(starts, minlength=len(edges)).astype(np.int32)
        edges -= np.bincount(starts + w, minlength=len(edges)).astype(np.int32)
    return np.cumsum(edges[:-1]) > 0


def slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * MULTIPLIER) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def run_hashes(chars: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``size`` characters at the given places."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(size):
        out = (out ^ chars[starts + i].astype(np.uint64)) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def short_items(items: list[tuple[object, np.ndarray]]) -> dict[int, tuple[np.ndarray, list[list[tuple[object, np.ndarray]]]]]:
    by_size: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for item, chars in items:
        h = int(run_hashes(chars, len(chars), np.zeros(1, np.int64))[0])
        by_size[len(chars)][h].append((item, chars))
    return {size: (np.array(sorted(own), np.uint64), [own[h] for h in sorted(own)]) for size, own in by_size.items()}


def search_short(chars: np.ndarray, index: Index) -> Iterator[tuple[object, int, int]]:
    """Item and place of every short item that stands between separators."""
    gap = np.array([SPACE], np.uint32)
    padded = np.concatenate([gap, chars, gap])
    blanks = np.flatnonzero(padded == SPACE)
    for size, (hashes, found) in index.short.items():
        starts = blanks[:-1][padded[np.minimum(blanks[:-1] + size + 1, len(padded) - 1)] == SPACE] + 1
        starts = starts[starts + size < len(padded)]
        own = run_hashes(padded, size, starts)
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        for k in np.flatnonzero(hashes[at] == own):
            start = int(starts[k])
            for item, wanted in found[at[k]]:
                if (padded[start : start + size] == wanted).all():
                    yield item, start - 1, start - 1 + size


def build_index(items: list[tuple[object, str | None]], edit_share: float = EDIT_SHARE) -> Index:
    table, own, segments, short = fold_table(), [], [], []
    for item, text in items:
        chars, _ = normalise(text or "", table)
        chars = chars[: len(chars) - 1] if len(chars) and chars[-1] == SPACE else chars
        if len(chars) < LEAST_CHARS:
            short += [(item, chars)] if len(chars) else []
            continue
        starts = range(0, len(chars) - SEGMENT, SEGMENT // 2) if len(chars) > SEGMENT else ()
        for at in [*starts, max(0, len(chars) - SEGMENT)]:
            own.append(item)
            segments.append(chars[at : at + SEGMENT])
    size = np.array([len(s) for s in segments], np.int64)
    # Under q * k < n - q + 1 the bound is above zero and the lemma filters.
    budget = np.minimum((size * edit_share).astype(np.int64), np.maximum(0, (size - Q) // Q))
    parts = [grams(s) for s in segments]
    codes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    order = np.argsort(codes, kind="stable")
    segment = np.repeat(np.arange(len(segments)), [len(p) for p in parts])[order]
    place = np.concatenate([np.arange(len(p)) for p in parts])[order] if parts else np.empty(0, np.int64)
    distinct, first = np.unique(codes[order], return_index=True)
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[slot(distinct)] = True
    return Index(own, segments, budget, size - Q + 1 - budget * Q, distinct, np.append(first, len(codes)), segment.astype(np.int64), place.astype(np.int64), bits, short_items(short))


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Least edits of the pattern against any part of the text, and where that part ends.

    Only cells (i, j) with low <= j - i <= high are visited.
    """
    width, size = high - low + 1, len(text)
    far = len(pattern) + size + width
    steps = np.arange(width)
    # Cell c of row i is text position j = i + low + c; outside the text nothing is equal or cheap.
    edge = np.full(abs(low) + width + len(pattern) + 1, 0xFFFFFFFF, np.uint32)
    padded, shift = np.concatenate([edge, text.astype(np.uint32, copy=False), edge]), len(edge) - 1 + low
    row = np.where((steps + low >= 0) & (steps + low <= size), 0, far)
    up, best = np.full(width, far), np.empty(width, row.dtype)
    for i in range(1, len(pattern) + 1):
        at = min(shift + i, len(padded) - width)
        np.add(row, padded[at : at + width] != pattern[i - 1], out=best)
        up[:-1] = row[1:]
        up[:-1] += 1
        np.minimum(best, up, out=best)
        best -= steps
        np.minimum.accumulate(best, out=row)
        row += steps
        j = i + low
        row[: max(0, -j)] = far
        row[max(0, size - j + 1) :] = far
    at = int(row.argmin())
    return int(row[at]), len(pattern) + low + at


def search(texts: list[str], index: Index, table: np.ndarray) -> list[list[tuple[object, int, int, int]]]:
    """For each text, its (item, start, end, edits); places are code points, the end is exclusive."""
    out: list[list] = [[] for _ in texts]
    for hits, text in zip(out, texts if index.short else ()):
        chars, own = normalise(text, table)
        hits += [(item, int(own[start]), int(own[end - 1]) + 1, 0) for item, start, end in search_short(chars, index)]
    if not len(index.codes):
        return [_merged(hits) for hits in out]
    classes = index.classes()
    for a, b in iterate_texts(texts, 1_000_000):
        chars, places = zip(*(normalise(t, table) for t in texts[a:b]))
        gap = np.zeros(Q, np.uint32)
        joined = np.concatenate([x for c in chars for x in (c, gap)])
        starts = np.concatenate([[0], np.cumsum([len(c) + Q for c in chars])])
        codes = grams(joined)
        hits = index.filter.take(slot(codes))
        at = np.flatnonzero(hits & dense(hits, classes))
        found = np.minimum(np.searchsorted(index.codes, codes[at]), len(index.codes) - 1)
        same = index.codes[found] == codes[at]
        at, found = at[same], found[same]
        repeats = index.first[found + 1] - index.first[found]
        entry = np.repeat(index.first[found] - np.concatenate([[0], np.cumsum(repeats)[:-1]]), repeats) + np.arange(repeats.sum())
        at = np.repeat(at, repeats)
        segment = index.segment[entry]
        # Diagonals are counted over the joined texts: another text starts elsewhere.
        step = index.budget[segment] + 1
        band = (at - index.place[entry] + SEGMENT) // step
        size = len(joined) + 2 * SEGMENT
        keys, counts = np.unique(segment * size + band, return_counts=True)
        # Band b counts the diagonals of cells b and b + 1.
        starts_at = np.union1d(keys, keys - 1)
        both = np.zeros(len(starts_at), np.int64)
        both[np.searchsorted(starts_at, keys)] += counts
        both[np.searchsorted(starts_at, keys - 1)] += counts
        for key in starts_at[both >= index.least[np.clip(starts_at // size, 0, len(index.least) - 1)]]:
            s, cell = divmod(int(key), size)
            k, pattern = int(index.budget[s]), index.segments[s]
            low = cell * (k + 1) - SEGMENT
            # Documents that the band can touch; mostly one.
            first, last = np.searchsorted(starts, [low, low + 2 * k + 1 + len(pattern)], side="right") - 1
            for d in range(max(0, first), min(last, len(chars) - 1) + 1):
                hit = _verify(pattern, chars[d], low - int(starts[d]), low + 2 * k + 1 - int(starts[d]), k)
                if hit:
                    own = places[d]
                    out[a + d].append((index.items[s], int(own[hit[0]]), int(own[hit[1] - 1]) + 1, hit[2]))
    return [_merged(hits) for hits in out]


def _verify(pattern: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """The place (start, end, edits) of the pattern on the given diagonals, if within k edits.

    The band is widened by k: the alignment may leave the diagonals of its q-grams at its ends.
    """
    at = _find(pattern, text, max(0, low), high + len(pattern))
    if at is not None:
        return at, at + len(pattern), 0
    edits, end = align(pattern, text, low - k, high + k)
    if edits > k:
        return None
    head = text[max(0, end - len(pattern) - k) : end]
    _, length = align(pattern[::-1], np.concatenate([head[::-1]]), -k, k) if edits else (0, len(pattern))
    return max(0, end - length), end, edits


def _find(pattern: np.ndarray, text: np.ndarray, start: int, end: int) -> int | None:
    """Where the pattern stands unedited in text[start:end]."""
    part, wanted = text[start:end].tobytes(), pattern.tobytes()
    at = part.find(wanted)
    while at % 4 and at >= 0:
        at = part.find(wanted, at + 1)
    return start + at // 4 if at >= 0 else None


def _merged(hits: list[tuple[object, int, int, int]]) -> list[tuple[object, int, int, int]]:
    """Overlapping places of one item as one, with the fewest edits of its segments."""
    by_item: dict[object, list] = defaultdict(list)
    for item, start, end, edits in hits:
        by_item[item].append((start, end, edits))
    out = []
    for item, spans in by_item.items():
        spans.sort()
        at, to, least = spans[0]
        for start, end, edits in spans[1:]:
            if start < to:
                to, least = max(to, end), min(least, edits)
            else:
                out.append((item, at, to, least))
                at, to, least = start, end, edits
        out.append((item, at, to, least))
    return sorted(out, key=lambda x: (x[1], x[2], str(x[0])))


def blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The items in lists of about ``block_chars`` characters, at least one list."""
    own = benchmark.select(F.col(item_id).alias("item_id"), blank(text).alias("text"))
    chars = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = max(1, -(-chars // block_chars))
    for k in range(count):
        part = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def contaminations(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row doc_id, item_id, start, end, edits for each place of an item in a document.

    Clean documents have no row. Places count code points, ends are exclusive. Items without a
    letter or digit, NULL ones included, are no evidence; those under ``LEAST_CHARS`` characters are
    found unedited, as whole words; a NULL or empty text holds nothing. Repeated rows are reported each, a NULL id as NULL;
    other columns are ignored; an empty table on either side gives no row.
    """
    text_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    kinds = dict(own.dtypes)["doc_id"], dict(benchmark.dtypes)[item_id]
    context = docs.sparkSession.sparkContext
    item_type = to_arrow_type(benchmark.schema[item_id].dataType)

    def one(items: list[tuple]) -> DataFrame:
        # As plain arrays: workers need not have the class.
        sent = context.broadcast(tuple(vars(build_index(items)).values()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, table = Index(*sent.value), fold_table()
            for batch in batches:
                hits = search(batch.column("text").to_pylist(), index, table)
                rows = [(d, *h) for d, found in zip(batch.column("doc_id").to_pylist(), hits) for h in found]
                yield arrow_rows(rows, {"doc_id": batch.schema.field("doc_id").type, "item_id": item_type, "start": pa.int64(), "end": pa.int64(), "edits": pa.int32()})

        return own.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, start long, end long, edits int")

    return reduce(DataFrame.unionByName, [one(items) for items in blocks(benchmark, item_id, item_text)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, all columns, that hold no place of a benchmark item.

    NULL and empty texts hold none and stay, repeated rows stay or go together; without items all stay.
    """
    context = docs.sparkSession.sparkContext

    text_batches(docs.sparkSession)

    def free_of(items: list[tuple]):
        sent = context.broadcast(tuple(vars(build_index(items)).values()))

        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index, table = Index(*sent.value), fold_table()
            for texts in batches:
                yield pd.Series([not hits for hits in search(list(texts), index, table)], dtype=bool)

        clean.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(clean, "boolean")(blank(text))

    return reduce(lambda kept, items: kept.where(free_of(items)), blocks(benchmark, item_id, item_text), docs)
