"""Byte-level BPE with a segment tree over the ranks of adjacent pairs, and its decoding.

A word starts as one symbol per byte. The leaves of a segment tree hold, for every symbol that still
stands, the rank of the merge of it and its right neighbour, with its place; an inner node holds the
smaller of its children. So the root is the lowest rank, and of equal ranks the leftmost pair. That
pair is merged, which changes three leaves (the pair's, its left neighbour's, and that of the symbol
which is gone) and their paths, until no pair in the tree has a rank. A word of n bytes takes
O(n log n) steps, however long it is. The trees of many short words stand side by side in one array, and
each step merges one pair of every word.

Texts are split into words first. A blank followed by anything but white space always begins a word, so
texts are cut there, and each such chunk is split by the vocabulary's pattern. Chunks and words recur:
their ids are kept for a bounded number of short ones. Special tokens in a text are taken as such.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from shiftlab.llm.common import blank, text_batches
from shiftlab.llm.packing import public_path
from shiftlab.llm.tokens import byte_letters

VOCABULARY = "byte_bpe_50k.json"
CACHE_CHUNKS = 400_000
CACHED_CHARS = 48
# Fixed value: the word pattern of byte-level vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Beyond these, versions of Unicode differ in what is a letter or a digit: the library splits such chunks.
UNSETTLED = re.compile(r"[^\x00-\u0556]").search
SPACED = re.compile(r" (?!\S)").search
PLACE_BITS = 40
PLACES = (1 << PLACE_BITS) - 1
NO_PAIR = 1 << 80
NO_RANK, NO_LEAF = 1 << 40, 1 << 60
# Words of up to so many symbols are merged in rows of so many words at a time.
ROW_SYMBOLS = 64
ROW_WORDS = 20_000


def pair_tree(leaves: list[int]) -> tuple[list[int], int]:
    """The nodes of a segment tree, the root at 1 and the leaves from ``size`` on, and ``size``."""
    size = 1 << max(0, len(leaves) - 1).bit_length()
    level = leaves + [NO_PAIR] * (size - len(leaves))
    levels = [level]
    while len(level) > 1:
        level = [a if a < b else b for a, b in zip(level[::2], level[1::2])]
        levels.append(level)
    nodes = [NO_PAIR]
    for level in reversed(levels):
        nodes += level
    return nodes, size


def set_leaf(nodes: list[int], at: int, leaf: int) -> None:
    """Change the leaf at the index ``at`` and its path, as far up as anything changes."""
    nodes[at] = leaf
    while at > 1:
        other = nodes[at ^ 1]
        least = leaf if leaf < other else other
        at >>= 1
        if nodes[at] == least:
            break
        nodes[at] = leaf = least


def merged(symbols: list[int], ranks: dict[int, int], products: list[int]) -> list[int]:
    """The symbols after all merges. ``ranks``: left << 32 | right to the rank, ``products`` the merged symbol of a rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    rank = ranks.get
    leaves = [NO_PAIR if (r := rank(a << 32 | b)) is None else r << PLACE_BITS | i for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
    nodes, size = pair_tree(leaves)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := nodes[1]) != NO_PAIR:
        i = least & PLACES
        symbol, gone = products[least >> PLACE_BITS], after[i]
        symbols[i], symbols[gone] = symbol, -1
        after[i] = following = after[gone]
        leaf = NO_PAIR
        if following < n:
            before[following] = i
            if nodes[size + gone] != NO_PAIR:
                set_leaf(nodes, size + gone, NO_PAIR)
            r = rank(symbol << 32 | symbols[following])
            if r is not None:
                leaf = r << PLACE_BITS | i
        set_leaf(nodes, size + i, leaf)
        previous = before[i]
        if previous >= 0:
            r = rank(symbols[previous] << 32 | symbol)
            leaf = NO_PAIR if r is None else r << PLACE_BITS | previous
            if nodes[size + previous] != leaf:
                set_leaf(nodes, size + previous, leaf)
    return [s for s in symbols if s >= 0]


class PairRanks:
    """Ranks and merged symbols of pairs of symbols, for single pairs and for arrays of them."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.ranks = {a << 32 | b: rank for rank, (a, b, _) in enumerate(merges)}
        self.products = [merged for _, _, merged in merges]
        pairs = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(pairs)
        self.pairs, self.order, self.product = pairs[order], order, np.array(self.products, np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``NO_RANK`` where there is none or a side is negative."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where((self.pairs[at] == wanted) & (right >= 0), self.order[at], NO_RANK)


def merged_rows(words: list[list[int]], size: int, table: PairRanks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``merged`` for many words of at most ``size`` (a power of two) symbols: one merge of each word at a time.

    Row r of ``nodes`` is the tree of a word. Yields numbers of words and their rows of symbols, with -1
    where a symbol is gone.
    """
    n = len(words)
    symbols = np.full((n, size + 1), -1, np.int64)  # the last column stands for no neighbour
    for r, word in enumerate(words):
        symbols[r, : len(word)] = word
    number, span = np.arange(n), np.arange(size + 1)
    after, before = np.tile(span + 1, (n, 1)), np.tile(np.where(span > 0, span - 1, size), (n, 1))
    rank = table.find(symbols[:, :size], symbols[:, 1:])
    nodes = np.full((n, 2 * size + 1), NO_LEAF, np.int64)
    nodes[:, size : 2 * size] = np.where(rank == NO_RANK, NO_LEAF, rank * size + span[:size])
    for at in range(size - 1, 0, -1):
        np.minimum(nodes[:, 2 * at], nodes[:, 2 * at + 1], out=nodes[:, at])
    while True:
        going = nodes[:, 1] < NO_LEAF
        if not going.all():
            yield number[~going], symbols[~going, :size]
            number, symbols, after, before, nodes = (x[going] for x in (number, symbols, after, before, nodes))
            if not len(number):
                return
        rows = np.arange(len(number))
        rank, at = np.divmod(nodes[:, 1], size)
        symbol, gone = table.product[rank], after[rows, at]
        following, previous = after[rows, gone], before[rows, at]
        symbols[rows, at], symbols[rows, gone] = symbol, -1
        after[rows, at], before[rows, following] = following, at
        left = symbols[rows, previous]
        # A word without a left neighbour writes to the column past the leaves.
        nodes[rows, size + gone] = NO_LEAF
        for place, found in ((at, table.find(symbol, symbols[rows, following])), (previous, np.where(left < 0, NO_RANK, table.find(left, symbol)))):
            nodes[rows, size + place] = np.where(found == NO_RANK, NO_LEAF, found * size + place)
        rows = np.tile(rows, 3)
        path = size + np.concatenate([gone, at, np.where(left < 0, at, previous)])
        for _ in range(size.bit_length() - 1):
            path >>= 1
            nodes[rows, path] = np.minimum(nodes[rows, 2 * path], nodes[rows, 2 * path + 1])


def merged_words(words: list[str], letters: list[int], table: PairRanks) -> Iterator[tuple[str, bytes]]:
    """Every word with its ids, little-endian unsigned 32-bit integers."""
    classes = defaultdict(list)
    for word in words:
        symbols = [letters[b] for b in word.encode("utf-8", "surrogatepass")]
        classes[max(2, 1 << (len(symbols) - 1).bit_length())].append((word, symbols))
    for size, own in classes.items():
        if size > ROW_SYMBOLS:
            for word, symbols in own:
                yield word, np.array(merged(symbols, table.ranks, table.products), "<u4").tobytes()
            continue
        for a in range(0, len(own), ROW_WORDS):
            part = own[a : a + ROW_WORDS]
            for numbers, rows in merged_rows([symbols for _, symbols in part], size, table):
                kept = rows >= 0
                ids, ends = rows[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
                for number, start, end in zip(numbers.tolist(), [0, *ends], ends):
                    yield part[number][0], ids[start:end]


class ByteBpe:
    """Encodes texts to ids and decodes ids, for a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        parts = json.loads(Tokenizer.from_file(path).to_str())
        vocabulary, merges = parts["model"]["vocab"], parts["model"]["merges"]
        letters = byte_letters()
        self.bytes = [vocabulary[letters[b]] for b in range(256)]
        self.table = PairRanks([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges])
        special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        # The longest of several that start at one place.
        longest = sorted(special, key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, longest))})") if special else None
        self.special_ids = {k: v.to_bytes(4, "little") for k, v in special.items()}
        self.split = regex.compile(WORD_PATTERN).findall
        self.library_split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        # Ids by chunk (without the blank in front of it) and by word.
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        values = {letter: bytes([b]) for b, letter in letters.items()}
        self.token_bytes = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
        for token, i in vocabulary.items():
            self.token_bytes[i] = b"".join(values[c] for c in token)
        for token, i in special.items():
            self.token_bytes[i] = token.encode()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit integers."""
        # Every other part of a text is a special token.
        cut = [[_chunks(p) if i % 2 == 0 else p for i, p in enumerate(self.special.split(t) if self.special else [t])] for t in texts]
        plain = [part for parts in cut for part in parts[::2]]
        firsts = {first for first, _ in plain}
        new = set().union(*(chunks for _, chunks in plain)).difference(self.chunks)
        told = {chunk: self.older.get(chunk) for chunk in new}
        split = {chunk: self._words(" " + chunk) for chunk, ids in told.items() if ids is None}
        starts = {first: self._words(first) for first in firsts}
        unknown = {word for words in (*split.values(), *starts.values()) for word in words}.difference(self.words)
        known = self.words
        known.update(merged_words(list(unknown), self.bytes, self.table))
        self.chunks.update((chunk, b"".join(map(known.__getitem__, split[chunk])) if ids is None else ids) for chunk, ids in told.items())
        begin = {first: b"".join(map(known.__getitem__, words)) for first, words in starts.items()}
        out, lookup = [], self.chunks.__getitem__
        for parts in cut:
            out.append(b"".join(self.special_ids[p] if i % 2 else begin[p[0]] + b"".join(map(lookup, p[1])) for i, p in enumerate(parts)))
        for cache, added in ((self.chunks, new), (known, unknown)):
            for key in added:
                if len(key) > CACHED_CHARS:
                    del cache[key]
        if len(self.chunks) > CACHE_CHUNKS:
            # Chunks seen since the last turn are kept for another one.
            self.older, self.chunks, self.words = self.chunks, {}, {}
        return out

    def decode(self, ids: bytes) -> str:
        joined = b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return joined.decode("utf-8", "replace")

    def _words(self, chunk: str) -> list[str]:
        if UNSETTLED(chunk):
            return [chunk[a:b] for _, (a, b) in self.library_split(chunk)]
        return self.split(chunk)


def _chunks(text: str) -> tuple[str, list[str]]:
    """The text up to the first blank that begins a word, and what follows each such blank."""
    first, *chunks = text.split(" ")
    if not SPACED(text):
        return first, chunks
    # Chunks that are empty or begin with white space are put back to what stands before them.
    parts = [[first]]
    for chunk in chunks:
        if not chunk or chunk[0].isspace():
            parts[-1].append(chunk)
        else:
            parts.append([chunk])
    first, *rest = (" ".join(p) for p in parts)
    return first, rest


def encode_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, path: str | None = None, with_ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; ``with_ids`` adds ids and decoded.

    A NULL text is empty and has no token; repeated rows are reported each, a NULL id as NULL. Other
    columns are ignored; an empty table gives no row. One pass without a shuffle. ``path`` names a
    vocabulary file that all executors have.
    """
    text_batches(docs.sparkSession)
    own = docs.select(docs[doc_id].alias("doc_id"), blank(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path or public_path(vocabulary))
        for batch in batches:
            counts, id_digests, text_digests, ids, decoded = [], [], [], [], []
            for encoded in bpe.encode(batch.column("text").to_pylist()):
                back = bpe.decode(encoded)
                counts.append(len(encoded) // 4)
                id_digests.append(hashlib.sha256(encoded).hexdigest())
                text_digests.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(encoded, "<u4").astype(np.int64))
                    decoded.append(back)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int64())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = T.StructType([own.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType())).add("decoded", T.StringType())
    return own.mapInArrow(run, schema)
