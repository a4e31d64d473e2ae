import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from shiftlab.llm import bpe
from shiftlab.llm.packing import public_path
from tests.llm.conftest import EDGE_ROWS


def library():
    tokenizer = Tokenizer.from_file(public_path(bpe.VOCABULARY))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def wanted(rows):
    plain, out = library(), []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        back = plain.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_small_documents_equal_the_library(small, small_rows):
    assert sorted(map(tuple, bpe.encode_documents(small("documents")).collect()), key=repr) == wanted(small_rows)


def test_edge_rows_and_empty_table(edge_docs, no_docs):
    assert sorted(map(tuple, bpe.encode_documents(edge_docs).collect()), key=repr) == wanted(EDGE_ROWS)
    assert bpe.encode_documents(no_docs).count() == 0
    for r in bpe.encode_documents(edge_docs.where("doc_id in (4, 9)"), with_ids=True).collect():
        assert r["decoded"] == dict(EDGE_ROWS)[r["doc_id"]] and len(r["ids"]) == r["n_tokens"]


def test_large_and_missing_ids_stay(make_docs):
    ids = {2**60 + 1, 2**60 + 3, None}
    assert {r["doc_id"] for r in bpe.encode_documents(make_docs([(i, "a text") for i in ids])).collect()} == ids


def test_odd_texts_equal_the_library():
    own, plain = bpe.ByteBpe(public_path(bpe.VOCABULARY)), library()
    rng = random.Random(3)
    texts = [
        "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n \nb", "\n\n", "a\t\tb ", " \x1c x", "x\x1c \x85 y\xa0z", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>c",
        "<|endoftext|", "don't WE'LL 's 're", "日本語 テスト １２３ ²³", "😀😀 é ՘ ꟎ x", "\x00 \x01\x7f", "1234 12a4 _a_ --- !!!\n", "ſ K İ ß ǆ", "ab" * 5000, "x" * 20_001, "​ 　  a",
    ]
    letters = "ab  \n\t'sté1,.<|　日\x1ć"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for text, encoded in zip(texts * 2, own.encode(texts) + [own.encode([t])[0] for t in texts]):
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoded, "<u4").tolist() == ids, text
        assert own.decode(encoded) == plain.decode(ids, skip_special_tokens=False) == text


def test_cache_turns_over(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    own, plain = bpe.ByteBpe(public_path(bpe.VOCABULARY)), library()
    for text in ("one two three four five", "two six seven one", "one eight " + "y" * 100, "four two y"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(own.chunks) <= 7 and "y" * 100 not in own.chunks


def test_tree_gives_the_leftmost_lowest_rank():
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 8, 33):
        leaves = [rng.randrange(4) << bpe.PLACE_BITS | i for i in range(n)]
        nodes, size = bpe.pair_tree(leaves)
        for _ in range(60):
            assert nodes[1] == min(leaves)
            i = rng.randrange(n)
            leaves[i] = rng.choice([bpe.NO_PAIR, rng.randrange(4) << bpe.PLACE_BITS | i])
            bpe.set_leaf(nodes, size + i, leaves[i])


def test_merges_equal_a_plain_loop():
    rng = random.Random(8)
    merges, symbols = {}, list(range(4))
    for _ in range(30):
        pair = rng.choice(symbols), rng.choice(symbols)
        if pair not in merges:
            merges[pair] = len(symbols)
            symbols.append(len(symbols))
    table = bpe.PairRanks([(a, b, new) for (a, b), new in merges.items()])
    ranks, products = table.ranks, table.products
    words, wanted = [], []
    for _ in range(500):
        word = [rng.randrange(4) for _ in range(rng.randrange(1, 40))]
        plain = list(word)
        while True:
            ranked = [(ranks[x << 32 | y], i) for i, (x, y) in enumerate(zip(plain, plain[1:])) if x << 32 | y in ranks]
            if not ranked:
                break
            rank, i = min(ranked)
            plain[i : i + 2] = [products[rank]]
        assert bpe.merged(word, ranks, products) == plain
        words.append(word)
        wanted.append(plain)
    rows = {n: row[row >= 0].tolist() for numbers, own in bpe.merged_rows(words, 64, table) for n, row in zip(numbers, own)}
    assert [rows[n] for n in range(500)] == wanted
