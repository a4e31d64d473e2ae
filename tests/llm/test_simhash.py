import random
import re

import numpy as np
import pytest
import xxhash

from shiftlab.llm import simhash


def plain_fingerprint(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def check(found, rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    wanted = sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots)), key=repr)
    assert sorted(map(tuple, found), key=repr) == wanted


def test_small_documents_equal_brute_force(small, small_rows):
    check(simhash.near_duplicates(small("documents")).collect(), small_rows)


def test_edge_rows_and_empty_table(edge_docs, no_docs):
    from tests.llm.conftest import EDGE_ROWS

    check(simhash.near_duplicates(edge_docs).collect(), EDGE_ROWS)
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.one_of_each(no_docs).count() == 0


def test_one_of_each_keeps_one_row_of_a_group(edge_docs):
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    # Documents 5, 5 and 6 are equal; 2, 3, 7 and the second without an id have no word.
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=repr) == sorted([1, 2, 4, 5, 8, 9, None], key=repr)


@pytest.mark.parametrize("leaf", [4, 64])
def test_trees_find_every_close_pair(leaf):
    rng = np.random.default_rng(leaf)
    points = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = points[:150] ^ sum(np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64) for _ in range(3))
    points = np.unique(np.concatenate([points, near]))
    pairs = {(i, j) for i in range(len(points)) for j in range(i) if int(points[i] ^ points[j]).bit_count() <= 3}
    together = set()
    for half in simhash.halves(points):
        tree = simhash.grow(half[::2], 1, leaf)
        for _, rows in simhash.route(tree, half, 1):
            together |= {(max(a, b), min(a, b)) for a in rows for b in rows}
    assert pairs and pairs <= together


def test_local_roots_of_a_tight_cluster():
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(800)} | {rng.getrandbits(64) for _ in range(300)}
    own = np.array(sorted(prints), np.uint64)
    roots = simhash.local_roots(own, 3, leaf=64)
    wanted = plain_components([int(p) for p in own])
    assert len(set(zip(roots, wanted))) == len(set(wanted)) == len(set(roots))


def test_links_across_many_shards(spark, tmp_path):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(400)]
    prints = list({p ^ m for p in base for m in (0, 1 << rng.randrange(64), 7 << rng.randrange(61))})
    path = str(tmp_path / "prints")
    spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").write.parquet(path)
    edges = simhash.links(spark.read.parquet(path), sample=200, shard_points=40).collect()
    position = {p: i for i, p in enumerate(prints)}
    unsigned = lambda v: v % (1 << 64)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in edges:
        a, b = find(position[unsigned(r["a"])]), find(position[unsigned(r["b"])])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == plain_components(prints)


def test_shards_with_a_common_half_are_split(spark, tmp_path):
    rng = random.Random(4)
    common = rng.getrandbits(32)
    # A hot half: two thirds of the prints share their upper 32 bits, each with a neighbour at up to 3 bits.
    base = [common << 32 | rng.getrandbits(32) for _ in range(1000)] + [rng.getrandbits(64) for _ in range(500)]
    prints = list({p ^ m for p in base for m in (0, 1 << rng.randrange(32) | 1 << rng.randrange(64) | 1 << rng.randrange(32))})
    path = str(tmp_path / "prints")
    spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").write.parquet(path)
    stored = spark.read.parquet(path)
    own = np.sort(np.array(prints, np.uint64))

    whole = stored.selectExpr("1 AS tree", "0 AS level", "CAST(0 AS LONG) AS shard", "fp")
    dealt = simhash.split_on(whole, 3, 400).collect()
    held = {}
    for r in dealt:
        held.setdefault((r["tree"], r["level"], r["shard"]), set()).add(r["fp"] % (1 << 64))
    assert max(map(len, held.values())) <= 400 < len(prints) and set().union(*held.values()) == set(prints)
    # By its upper half the tree promises pairs that differ there in one bit or less.
    near = np.bitwise_count(own[:, None] ^ own[None]) <= 3
    near &= np.bitwise_count((own[:, None] ^ own[None]) >> np.uint64(32)) <= 1
    wanted = {(int(own[i]), int(own[j])) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
    assert len(wanted) > 1000 and all(any(a in s and b in s for s in held.values()) for a, b in wanted)

    edges = simhash.links(stored, sample=200, shard_points=30).collect()
    place = {int(p): i for i, p in enumerate(own)}
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def link(a, b):
        root[max(find(a), find(b))] = min(find(a), find(b))

    for r in edges:
        link(place[r["a"] % (1 << 64)], place[r["b"] % (1 << 64)])
    found = [find(i) for i in range(len(own))]
    root = list(range(len(own)))
    for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None]) <= 3, 1))):
        link(i, j)
    assert found == [find(i) for i in range(len(own))]


def test_points_that_nothing_parts_stay_together(spark, tmp_path):
    path = str(tmp_path / "prints")
    spark.createDataFrame([(1 << i,) for i in range(60)], "fp long").write.parquet(path)
    whole = spark.read.parquet(path).selectExpr("0 AS tree", "0 AS level", "CAST(0 AS LONG) AS shard", "fp")
    assert simhash.split_on(whole, 3, 10).count() >= 60
    edges = simhash.links(spark.read.parquet(path), shard_points=2).collect()
    assert len({r["a"] for r in edges}) == 59
