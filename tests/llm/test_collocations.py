import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.llm import collocations
from shiftlab.llm.queries import op11_collocations

SMALL = "/root/testdata/sf0.001"


def phrase_counts(docs):
    """Counts of phrases of one to three words by language, of (lang, text) rows."""
    counts = defaultdict(Counter)
    for lang, text in docs:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts


def brute(docs, least=10, top=2000, cover=50):
    out = []
    for lang, f in phrase_counts(docs).items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in candidates.items():
            for part in (p[:2], p[1:]) if len(p) == 3 else ():
                most[part] = max(most[part], a)
        rows = []
        for p, a in candidates.items():
            if 100 * most[p] < cover * a:
                cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def make_langs(spark, tmp_path_factory):
    def make(rows):
        path = str(tmp_path_factory.mktemp("langs") / "documents.parquet")
        kinds = T.StructType([T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])
        clashing = [F.lit("x").alias(c) for c in ("h1", "h2", "h3", "n", "a", "word", "phrase", "rank", "walk", "flow", "salt")]
        spark.createDataFrame(rows, kinds).select("*", *clashing).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


def found(df):
    return sorted(map(tuple, df.collect()))


def test_small_documents_equal_brute_force_and_sql(spark, small):
    rows = [tuple(r) for r in small("documents").select("lang", "text").collect()]
    own = op11_collocations(spark, SMALL)
    assert found(own) == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    sql = con.execute(collocations.ORACLE)
    assert [c[0] for c in sql.description] == own.columns and sorted(sql.fetchall()) == found(own)


EDGES = [
    ("en", None), ("en", ""), (None, "a b c a b c. a b; c a\tb  c"), ("und", "A B C!a b\nc \x0b a b c"), ("en", " ,.;:!? \n"), ("fr", "é à é à é à é à x\x00y É à"),
    ("en", "word and " * 4000 + "end."), ("en", "same text here twice"), ("en", "same text here twice"), ("de", "ha " * 50), ("de", "ha"), ("es", "日 本 語 日 本 語"),
]


def test_edge_rows_and_empty_table(make_langs):
    assert found(collocations.collocations(make_langs(EDGES), least=2)) == brute(EDGES, 2)
    assert found(collocations.collocations(make_langs(EDGES), least=1, top=5, cover=90)) == brute(EDGES, 1, 5, 90)
    assert collocations.collocations(make_langs([])).count() == 0


def walks(seed, docs=200):
    """Texts with passages that many share, of few words, so that unary paths and junctions abound."""
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(2, 40))) for _ in range(12)]
    parts = lambda: rng.choice([rng.choice(passages), "a1 b2", "c3", "x y z", ". ", "\n"])
    return [(rng.choice(["en", "de", None]), " ".join(parts() for _ in range(rng.randrange(1, 9)))) for _ in range(docs)]


@pytest.mark.parametrize("chunk", [40, 3_000_000])
def test_random_walks_in_small_and_large_chunks(make_langs, monkeypatch, chunk):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(collocations, "CHUNK_VOCABULARY", 30)
    monkeypatch.setattr(collocations, "HOT_LEAST", 2)
    rows = walks(chunk)
    docs = make_langs(rows)
    assert len(collocations.hot_nodes(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), 0))
    assert found(collocations.collocations(docs, least=3)) == brute(rows, 3)


def test_counts_follow_from_edges_and_piece_ends(make_langs):
    rows = walks(9)
    word_counts, nodes, paths = collocations.graph(make_langs(rows), least=2)
    words = {r["h"]: (r["lang"], r["word"], r["n"]) for r in word_counts.collect()}
    wanted = phrase_counts(rows)
    assert {(lang, w): n for lang, w, n in words.values()} == {(lang, p[0]): a for lang, f in wanted.items() for p, a in f.items() if len(p) == 1}
    flows = {(words[r["h1"]][0], words[r["h1"]][1], words[r["h2"]][1]): r["flow"] for r in nodes.collect()}
    assert flows == {(lang, *p): a for lang, f in wanted.items() for p, a in f.items() if len(p) == 2 and a >= 2}
    edges, longest = {}, 0
    for r in paths.collect():
        walk = [words[h][1] for h in (r["h1"], r["h2"], *r["tail"])]
        longest = max(longest, len(walk))
        for i in range(len(walk) - 2):
            key = (words[r["h1"]][0], *walk[i : i + 3])
            assert key not in edges
            edges[key] = r["n"]
            # Inside a path every pair occurs as often as the path.
            assert i == 0 or flows[key[:3]] == r["n"]
        assert flows[(words[r["h1"]][0], *walk[:2])] == r["flow"]
    assert edges == {(lang, *p): a for lang, f in wanted.items() for p, a in f.items() if len(p) == 3 and a >= 2}
    assert longest > 10 and len(nodes.columns) == 3


def test_scores_beyond_64_bits_are_exact(spark):
    big = 3_037_000_500_123
    row = spark.createDataFrame([(big, big + 1, big + 7, big, big + 9)], "a long, x long, y long, z long, w long").select(collocations._lowest_cut("a", "x", "y", "z", "w").alias("b")).first()["b"]
    cuts = [(1_000_000 * big * big // ((big + 1) * (big + 7)), big + 1, big + 7), (1_000_000 * big * big // (big * (big + 9)), big, big + 9)]
    assert (row["score"], row["l"], row["r"]) == min(cuts, key=lambda c: c[0])


def test_words_that_share_a_hash_get_another_seed(make_langs, monkeypatch):
    plain = collocations.xxhash.xxh64_intdigest

    class Clashing:
        @staticmethod
        def xxh64_intdigest(data, seed=0):
            return 12345 if data in (b"a1", b"b2") and seed == plain(b"en", 0) else plain(data, seed)

    # Workers get the function by value, and with it this module's name.
    monkeypatch.setattr(collocations, "xxhash", Clashing)
    rows = [("en", "a1 b2 a1 b2 a1")] * 12
    own = make_langs(rows).select("lang", "text")
    if own.mapInArrow(collocations._new_words(0), "h long, lang string, word string").distinct().select("h").distinct().count() == 1:
        assert collocations.dictionary(own)[1] == 1
    assert found(collocations.collocations(own)) == brute(rows)


def test_triples_beyond_the_packed_range():
    numbers = np.array([5, 6, 7, 0, 0, 5, 6, 0, 0])
    few = np.arange(100, 110)
    many = np.arange(100, 100 + (1 << 21))
    rows = [[tuple(r.values()) for b in collocations._counted(numbers, h, np.empty(0, np.uint64)) for r in b.to_pylist()] for h in (few, many)]
    assert sorted(rows[0]) == sorted(rows[1]) and sum(r[4] for r in rows[0]) == 5
