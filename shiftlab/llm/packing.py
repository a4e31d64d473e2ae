"""Hierarchical packing of documents into training sequences of several lengths.

Documents become token ids with an end id. Whole windows of the longest context are cut off; what is
left of a document goes to the smallest context tier that holds it. Tiers are packed from the longest
to the shortest: a window opens with a document of its own tier, its gap takes the longest documents
of shorter tiers that fit, and what then remains is filled with a cut of one of them. So every window
is full; only the last tokens of a packing group are cut into ever shorter powers of two, which need
no padding either.

A packing group is a run of about ``GROUP_TOKENS`` tokens within one Spark partition; partitions are
packed independently, in one pass and without a shuffle, and nothing larger than a group is held. A
sequence is dealt to the step group of its packing group that has the fewest tokens so far, longest
sequences first, so step groups hold nearly equal numbers of tokens and mix all tiers.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shiftlab.llm.common import arrow_rows, blank, text_batches
from shiftlab.llm.tokens import WordTokens

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
TIERS = (256, 512, 1024, 2048)
GROUP_TOKENS = 2**21
STEP_TOKENS = 2**17
COLUMNS = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, tier int, step_group long"
)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pool:
    """Pieces (length, document, start) of one tier, by length."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []

    def add(self, item: tuple[int, int, int]) -> None:
        self.items.insert(bisect_right(self.items, item), item)

    def longest_within(self, room: int) -> tuple[int, int, int] | None:
        at = bisect_right(self.items, (room, 1 << 60, 0))
        return self.items.pop(at - 1) if at else None


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, [(document, start, length), ...]) that hold every token of each document once.

    ``lengths`` are the documents' tokens; tiers are powers of two, ascending. Each sequence is full
    up to its tier or has a power of two of tokens.
    """
    longest = tiers[-1]
    pools = {t: _Pool() for t in tiers}
    sequences = []
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        sequences += [(longest, [(doc, at, longest)]) for at in range(0, whole, longest)]
        if n > whole:
            pools[next(t for t in tiers if t >= n - whole)].items.append((n - whole, doc, whole))
    for pool in pools.values():
        pool.items.sort()

    def put_back(length: int, doc: int, start: int) -> None:
        pools[next(t for t in tiers if t >= length)].add((length, doc, start))

    for k in range(len(tiers) - 1, -1, -1):
        tier, shorter = tiers[k], [pools[t] for t in reversed(tiers[: k + 1])]
        while pools[tier].items:
            length, doc, start = pools[tier].items.pop()
            held, room = [(doc, start, length)], tier - length
            while room:
                found = next((x for x in (p.longest_within(room) for p in shorter) if x), None)
                if found is None:
                    # Nothing fits whole: fill up with the head of the shortest piece there is.
                    source = next((p for p in reversed(shorter) if p.items), None)
                    if source is None:
                        break
                    n, doc, start = source.items.pop(0)
                    put_back(n - room, doc, start + room)
                    found = (room, doc, start)
                held.append((found[1], found[2], found[0]))
                room -= found[0]
            if room:
                sequences += _powers(held)
            else:
                sequences.append((tier, held))
    return sequences


def _powers(pieces: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """The pieces' tokens in their order, cut into sequences whose lengths are falling powers of two."""
    left, out = sum(n for _, _, n in pieces), []
    todo = list(reversed(pieces))
    while left:
        size = room = 1 << (left.bit_length() - 1)
        held = []
        while room:
            doc, start, n = todo.pop()
            took = min(n, room)
            held.append((doc, start, took))
            if took < n:
                todo.append((doc, start + took, n - took))
            room -= took
        out.append((size, held))
        left -= size
    return out


def deal(sizes: list[int], steps: int) -> list[int]:
    """A step for each sequence, longest first to the step with the fewest tokens."""
    load = [(0, s) for s in range(steps)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        tokens, step = heapq.heappop(load)
        out[i] = step
        heapq.heappush(load, (tokens + sizes[i], step))
    return out


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    path: str | None = None,
    with_ids: bool = False,
    group_tokens: int = GROUP_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece of a document: its place in the document and in its sequence.

    ``with_ids`` adds the piece's token ids. A NULL or empty text is a document of the end id alone;
    rows that repeat an id are packed as documents of their own, a NULL id stays NULL. Other columns
    are ignored; an empty table gives no row. ``path`` names a vocabulary file that all executors have.
    """
    id_kind = dict(docs.dtypes)[doc_id]
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokens(path or public_path(vocabulary)).encode
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 36
        step = number

        def flush() -> pa.RecordBatch:
            nonlocal number, step
            sequences = pack([len(t) // 4 for _, t in group])
            sizes = [sum(p[2] for p in held) for _, held in sequences]
            steps = max(1, round(sum(sizes) / step_tokens))
            rows = []
            for (tier, held), size, dealt in zip(sequences, sizes, deal(sizes, steps)):
                at = 0
                for doc, start, n in held:
                    own, tokens = group[doc]
                    piece = tokens[4 * start : 4 * (start + n)]
                    row = (own, start, n, zlib.crc32(piece), len(tokens) // 4, number, at, size, tier, step + dealt)
                    rows.append((*row, np.frombuffer(piece, "<u4").astype(np.int64)) if with_ids else row)
                    at += n
                number += 1
            step += steps
            group.clear()
            return arrow_rows(rows, {"doc_id": id_type, **types})

        group: list[tuple[object, bytes]] = []
        held = 0
        id_type = pa.null()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for own, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                group.append((own, encode(t) + end))
                held += len(group[-1][1]) // 4
                if held >= group_tokens:
                    yield flush()
                    held = 0
        if group:
            yield flush()

    schema = f"doc_id {id_kind}, {COLUMNS}" + (", ids array<long>" if with_ids else "")
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    types = {name: kinds[kind] for name, kind in (c.split() for c in schema.split(", ")[1:])}
    text_batches(docs.sparkSession)
    own = docs.select(docs[doc_id].alias("doc_id"), blank(text).alias("text"))
    return own.mapInArrow(run, schema)
