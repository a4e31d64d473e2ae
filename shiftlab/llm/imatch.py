"""I-Match fingerprints: hashes of a text's terms under randomised subsets of a lexicon.

The lexicon holds the terms whose inverse document frequency lies in a band: neither words of most
texts nor words of a few. Frequencies are counted over all documents, per 64-bit hash of a term, so
terms do not share a count however many there are. A fingerprint starts with a hash of the text's
sorted distinct lexicon terms; further slots hash the terms that lie in one of many random subsets of
the lexicon, denser and sparser ones, so texts that share most of their terms agree in some slots.
Likeness is the share of equal slots among those that are not empty in both.

The lexicon grows with the vocabulary, so only its most frequent terms are sent to all executors, up to
a fixed number of bytes. As long as that is the whole lexicon, one pass makes the fingerprints. Beyond
it the terms of the texts that were not sent are looked up by a join with the rest of the lexicon. Hot
terms are among those sent: a term that is joined occurs in few documents.

The next document, whose beginning is spliced in by ``edited_documents``, is found by ordering the
documents in ranges of ids; every range also receives the first document of the following one. Ranges
hold about equal bytes of text, each is one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.llm.common import arrow_rows, blank, staged, text_batches

COUNTED_TERMS = 1_000_000
IDS_PER_RANGE = 20  # sampled ids that are not numbers
FINER = 8  # measured ranges of ids to a range of the result
# The most frequent terms that matter are sent to all executors up to this size, 8 bytes each.
SENT_BYTES = 32_000_000
# The band, as powers of the number of documents N: a term's document frequency lies between them.
RAREST, COMMONEST = 0.15, 0.85
# Levels of subsets as (cells the lexicon is dealt to, cells used): each used cell is a subset.
LEVELS = ((4, 4), (16, 16), (64, 24), (256, 24), (1024, 24))
SUBSETS = sum(used for _, used in LEVELS)
SLOT_BYTES = 3
EMPTY = bytes(SLOT_BYTES)


def terms(text: str) -> np.ndarray:
    """Sorted hashes of the distinct words: lower case, without punctuation at their ends."""
    words = {w.strip(punctuation) for w in set(text.lower().split())}
    words.discard("")
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, its hash as a signed integer, and n, its document frequency over all documents."""

    def counted(held: list[np.ndarray]) -> pd.DataFrame:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"term": values.view(np.int64), "n": n.astype(np.int64)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for t in batch["text"]:
                held.append(terms(t))
                size += len(held[-1])
                if size >= COUNTED_TERMS:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    counts = docs.select(blank(text).alias("text")).mapInPandas(count, "term long, n long")
    return counts.groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str = "text", sent_bytes: int = SENT_BYTES) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """The lexicon's most frequent terms, sorted; the terms above the band; the rest of the lexicon.

    The first two take ``sent_bytes`` at most. Where all terms fit, the rest is None; otherwise the first
    two hold all terms from some frequency on, a power of two, and the table ``term`` the rarer ones.
    """
    documents = max(docs.count(), 1)
    least, most = max(2.0, documents**RAREST), documents**COMMONEST
    counted = staged(frequencies(docs, text).where(F.col("n") >= least), "term-frequencies")
    digits = F.length(F.bin("n"))
    sizes = dict(counted.groupBy(digits.alias("digits")).count().collect())  # a row per power of two
    cut, held = 0, 0
    for power in sorted(sizes, reverse=True):
        held += 8 * sizes[power]
        if held > sent_bytes:
            cut = 1 << power
            break
    sent = counted.where(F.col("n") >= cut).select("term", (F.col("n") <= most).alias("inside")).toPandas()
    values, inside = sent["term"].to_numpy(np.int64).view(np.uint64), sent["inside"].to_numpy(bool)
    rest = counted.where((F.col("n") < cut) & (F.col("n") <= most)).select("term") if cut else None
    return np.sort(values[inside]), np.sort(values[~inside]), rest


def within(own: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Which of the terms are among the sorted ones."""
    if not len(band):
        return np.zeros(len(own), bool)
    return band.take(np.searchsorted(band, own), mode="clip") == own


def fingerprint(text: str, band: np.ndarray) -> bytes:
    """The slots of a text, one after the other; a subset without a term of the text is an empty slot.

    A text none of whose terms is in the lexicon is fingerprinted by all its terms, one without terms
    by its characters: texts are never alike for what they lack.
    """
    every = terms(text)
    return print_of(every, within(every, band)) if len(every) else print_without_terms(text)


def print_without_terms(text: str) -> bytes:
    return _slot(text.encode("utf-8", "surrogatepass"), 1) + EMPTY * SUBSETS


def print_of(every: np.ndarray, inside: np.ndarray) -> bytes:
    """The slots of a text with these terms, of which some are in the lexicon."""
    own = every[inside] if inside.any() else every
    slots = [EMPTY] * (1 + SUBSETS)
    slots[0] = _slot(own.tobytes(), 0)
    at = 1
    for level, (cells, used) in enumerate(LEVELS, 1):
        # Every level orders the lexicon anew and deals it to its cells.
        keyed = (own ^ np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        keyed = (keyed ^ (keyed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        keyed = np.sort(keyed[keyed < np.uint64(used * (1 << 64) // cells)] if used < cells else keyed)
        data, cell = keyed.tobytes(), keyed // np.uint64((1 << 64) // cells)
        ends = np.searchsorted(cell, np.arange(used + 1, dtype=np.uint64)).tolist()
        for k, (start, end) in enumerate(zip(ends, ends[1:])):
            if end > start:
                slots[at + k] = _slot(data[8 * start : 8 * end], level)
        at += used
    return b"".join(slots)


def _slot(data: bytes, seed: int) -> bytes:
    return (xxhash.xxh64_intdigest(data, seed) % (256**SLOT_BYTES - 1) + 1).to_bytes(SLOT_BYTES, "big")


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal slots among those not empty in both; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(s, np.uint8).reshape(-1, SLOT_BYTES) for s in (a, b))
    used = np.count_nonzero(x.any(axis=1) | y.any(axis=1))
    return (np.count_nonzero((x == y).all(axis=1)) - len(x) + used) / used


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


# --- the next document --------------------------------------------------------------------------


def _bounds(docs: DataFrame, ranges: int) -> list:
    """Up to ``ranges`` ids that part the ids into ranges of about equal bytes of text.

    They are chosen among the bounds of finer ranges, quantiles for numbers and those of a sample for
    other ids; the bytes of every fine range are summed over all documents.
    """
    known, kind = docs.where("doc_id is not null"), docs.schema["doc_id"].dataType
    if ranges < 2:
        return []
    count = FINER * ranges
    shares = [i / count for i in range(1, count)]
    if isinstance(kind, T.IntegralType):
        quantiles = known.select(F.col("doc_id").cast("long").alias("id")).approxQuantile("id", shares, 0.5 / count)
        fine = sorted({int(q) for q in quantiles})
    else:
        ids = known.select("doc_id")
        sample = sorted(r[0] for r in ids.sample(min(1.0, IDS_PER_RANGE * ranges / max(ids.count(), 1)), seed=5).collect())
        fine = sorted({sample[int(q * len(sample))] for q in shares}) if sample else []
    size = F.sum(F.octet_length("text") + F.lit(1).cast("long"))
    sizes = dict(known.groupBy(_below(fine).alias("range")).agg(size).collect())  # a row per fine range
    share, held, out = sum(sizes.values()) / ranges, 0, []
    for i, bound in enumerate(fine):
        held += sizes.get(i, 0)
        if held >= share * (len(out) + 1):
            out.append(bound)
    return out


def _below(bounds: list) -> Column:
    """How many of the sorted bounds are smaller than the id: whole groups of them first, then those of one group."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]

    def smaller(held: Column) -> Column:
        return F.size(F.filter(held, lambda b: b < F.col("doc_id")))

    whole = smaller(F.array(*(F.lit(g[-1]) for g in groups)))
    one = F.get(F.array(*(F.array(*map(F.lit, g)) for g in groups)), whole)
    return F.when(whole < len(groups), whole * width + smaller(one)).otherwise(len(bounds)).cast("int")


def in_order(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, part, extra: parts are ranges of falling ids; NULL ids form the last part.

    Every part also holds, marked extra, the document that starts the next part that is not empty; the
    last part the first document of all.
    """
    return _parted(docs, _bounds(docs, ranges))


def _parted(docs: DataFrame, bounds: list) -> DataFrame:
    part = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(len(bounds) - _below(bounds)).cast("int")
    parted = docs.withColumn("part", part)
    # One row per range reaches the driver.
    heads = sorted(tuple(r) for r in parted.groupBy("part").agg(F.max("doc_id")).collect())
    into = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(into, f"head {dict(docs.dtypes)['doc_id']}, part int")
    first = docs.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", "part", F.lit(True).alias("extra"))
    return parted.select("doc_id", "text", "part", F.lit(False).alias("extra")).unionByName(first)


def edited_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Fingerprints of every document and of its edited text: see the columns below.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next
    document is the one with the next smaller id (rows that repeat an id in the order of their texts,
    NULL ids last, after the last the first); a document alone follows itself. NULL texts are empty.
    Other columns are ignored; an empty table gives no row. ``sent_bytes`` bounds what is sent of the
    lexicon and does not change the result.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), blank(text).alias("text"))
    spark = docs.sparkSession
    text_batches(spark)
    bounds = _bounds(own, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = _parted(own, bounds).repartitionById(len(bounds) + 2, "part")
    order = dealt.sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "text")
    band, above, rest = lexicon(own, sent_bytes=sent_bytes)
    id_type = dict(own.dtypes)["doc_id"]
    if rest is not None:
        return _joined(order, id_type, band, above, rest)
    sent = spark.sparkContext.broadcast(band)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value

        def row(own: str, own_print: bytes, following: str, next_print: bytes) -> tuple:
            new = edited(own, following)
            return len(own), _digest(new), *_prints(own_print, own_print if new == own else fingerprint(new, known), next_print)

        yield from _pairs(batches, lambda t: fingerprint(t, known), row, TYPES)

    return order.mapInArrow(compare, f"doc_id {id_type}, {COLUMNS}")


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
TYPES = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
# Terms of a text, its edited text and the next one, their fingerprints if they have none, and terms to look up.
OPEN_COLUMNS = "n_chars long, edited_sha256 string, terms array<array<long>>, prints array<binary>, open array<long>"
OPEN_TYPES = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "terms": pa.list_(pa.list_(pa.int64())), "prints": pa.list_(pa.binary()), "open": pa.list_(pa.int64())}


def _joined(order: DataFrame, id_type: str, band: np.ndarray, above: np.ndarray, rest: DataFrame) -> DataFrame:
    """The result where the rest of the lexicon is a table: open terms of a row are joined to it."""
    sent = order.sparkSession.sparkContext.broadcast((band, above))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value

        def row(own: str, own_terms: np.ndarray, following: str, next_terms: np.ndarray) -> tuple:
            new = edited(own, following)
            held = own_terms, own_terms if new == own else terms(new), next_terms
            prints = [None if len(h) else print_without_terms(t) for h, t in zip(held, (own, new, following))]
            every = np.unique(np.concatenate(held))
            every = every[~(within(every, known[0]) | within(every, known[1]))]
            return len(own), _digest(new), [h.view(np.int64) for h in held], prints, every.view(np.int64)

        yield from _pairs(batches, terms, row, OPEN_TYPES)

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value[0]
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "n_chars", "edited_sha256", "terms", "prints", "found"))
            for own_id, n_chars, digest, held, prints, found in zip(*columns):
                rare = np.sort(np.array(found or [], np.int64).view(np.uint64))
                three = []
                for ready, values in zip(prints, held):
                    every = np.array(values, np.int64).view(np.uint64)
                    three.append(print_of(every, within(every, known) | within(every, rare)) if ready is None else ready)
                rows.append((own_id, n_chars, digest, *_prints(*three)))
            yield arrow_rows(rows, {"doc_id": batch.schema.field("doc_id").type, **TYPES})

    pairs = order.mapInArrow(opened, f"doc_id {id_type}, {OPEN_COLUMNS}").withColumn("number", F.monotonically_increasing_id())
    pairs = staged(pairs, "open-terms")
    wanted = pairs.select("number", F.explode("open").alias("term"))
    found = wanted.join(rest, "term", "left_semi").groupBy("number").agg(F.collect_list("term").alias("found"))
    return pairs.drop("open").join(found, "number", "left").drop("number").mapInArrow(closed, f"doc_id {id_type}, {COLUMNS}")


def _pairs(batches: Iterator[pa.RecordBatch], describe: Callable, row: Callable, types: dict) -> Iterator[pa.RecordBatch]:
    """A row for each document of the parts and the one that follows it; a text is described once."""
    held = None  # a document that waits for the next one: (id, text, description, part)
    for batch in batches:
        rows = []
        for own_id, t, part, extra in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "extra"))):
            if held is None and extra:
                continue  # a further row with the id of the following part's first document
            described = describe(t)
            if held is not None:
                if held[3] != part:
                    raise ValueError("a part does not end with the document that follows it")
                rows.append((held[0], *row(held[1], held[2], t, described)))
            held = None if extra else (own_id, t, described, part)
        yield arrow_rows(rows, {"doc_id": batch.schema.field("doc_id").type, **types})
    if held is not None:
        raise ValueError("a part does not end with the document that follows it")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _prints(own: bytes, new: bytes, following: bytes) -> tuple:
    return own.hex(), new.hex(), likeness(own, new), likeness(own, following)
