import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from shiftlab.llm import packing
from shiftlab.llm.tokens import WordTokens


def tokenizer():
    return Tokenizer.from_file(packing.public_path(packing.VOCABULARY))


def check(found, rows, group_tokens=packing.GROUP_TOKENS):
    plain, wanted = tokenizer(), defaultdict(list)
    for i, t in rows:
        wanted[i].append([*plain.encode(t or "", add_special_tokens=False).ids, packing.END_ID])
    tokens, sequences = defaultdict(int), defaultdict(list)
    for r in found:
        own = [ids for ids in wanted[r["doc_id"]] if len(ids) == r["doc_tokens"] and ids[r["start"] : r["start"] + r["length"]] == list(r["ids"])]
        assert own and len(r["ids"]) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        tokens[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append(r)
    assert tokens == {i: sum(map(len, own)) for i, own in wanted.items()}
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == pieces[0]["sequence_tokens"] <= 2048 and at & (at - 1) == 0
    return sequences


def test_small_documents_are_packed_whole(small, small_rows):
    sequences = check(packing.pack_documents(small("documents"), with_ids=True).collect(), small_rows)
    pieces = [r for s in sequences.values() for r in s]
    # One cut document per sequence at most, on top of what is longer than a window.
    assert len(pieces) < len(small_rows) + len(sequences)
    load = defaultdict(int)
    for s in sequences.values():
        load[s[0]["step_group"]] += s[0]["sequence_tokens"]
    assert max(load.values()) - min(load.values()) <= 4096


def test_edge_rows_and_empty_table(edge_docs, no_docs):
    from tests.llm.conftest import EDGE_ROWS

    check(packing.pack_documents(edge_docs, with_ids=True, group_tokens=64, step_tokens=16).collect(), EDGE_ROWS)
    assert packing.pack_documents(no_docs).count() == 0


def test_pieces_cover_random_lengths():
    rng = random.Random(6)
    for _ in range(60):
        lengths = [rng.choice([1, 2, 63, 64, 255, 256, 257, 1024, 2047, 2048, 2049, rng.randrange(1, 9000)]) for _ in range(rng.randrange(0, 40))]
        seen = defaultdict(list)
        for size, held in packing.pack(lengths):
            n = sum(x[2] for x in held)
            assert n <= 2048 and n & (n - 1) == 0 and n <= size
            for doc, start, took in held:
                seen[doc].append((start, took))
        for doc, n in enumerate(lengths):
            at = 0
            for start, took in sorted(seen[doc]):
                assert start == at and took > 0
                at += took
            assert at == n


def test_cached_tokens_equal_the_library():
    own, plain = WordTokens(packing.public_path(packing.VOCABULARY)), tokenizer()
    texts = [
        "", "  ", "a\x1cb c", "İstanbul ΑΣ ΑΣΑ", "don't we'LL <|endoftext|>x <|startoftext|>", "日本語 テスト 123", "été ﬁ ½ ª º", "a\xa0b c\x85d", "😀 hi", "ÀÉ ß µ ÿ",
        "x" * 3000, "'S 'Re it's", "​a b c", "é ﬁ", "mixed123abc 4.5,6!? --",
    ]
    for text in texts * 2:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_steps_are_balanced():
    sizes = [2048] * 10 + [1024] * 7 + [256] * 9
    steps = packing.deal(sizes, 4)
    load = [sum(s for s, at in zip(sizes, steps) if at == k) for k in range(4)]
    assert max(load) - min(load) <= 256
