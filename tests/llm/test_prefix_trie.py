import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.llm import prefix_trie
from shiftlab.llm.queries import op12_prefix_trie

EMPTY = hashlib.sha256().hexdigest()


def brute(turns, block=20):
    """Nodes of (conv_id, turn, role, text) rows, by plain dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn, digest, (role, text)))
    said = {c: [x[3] for x in sorted(rows, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, rows in own.items()}
    if block:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in said}
        said = {c: said.get(c - c % block, [])[: h[c]] + t[h[c] :] for c, t in said.items()}
    members = defaultdict(list)
    for c, t in said.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(convs) - 1) * words
            leaves[node[:d]] += node not in children
    out = []
    for node, convs in members.items():
        ended = ",".join(map(str, sorted(c for c in convs if len(said[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def make_turns(spark, tmp_path_factory):
    def make(rows):
        kinds = (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()))
        path = str(tmp_path_factory.mktemp("turns") / "conversations.parquet")
        clashing = [F.lit("x").alias(c) for c in ("key", "keys", "depth", "n", "first", "words", "group", "parent")]
        df = spark.createDataFrame(rows, T.StructType([T.StructField(*k) for k in kinds]))
        df.select("*", *clashing).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


def random_turns(seed, convs=60, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), convs):
        for turn in range(rng.choice([1, 2, 3, longest])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a b", "", None, "c", "d e  f\n"])))
    return rows


EDGES = [
    (0, 1, "user", "one two"), (0, None, "system", "first"), (0, 2, None, None), (3, 1, "user", "x"), (3, 1, "user", "x"), (3, 1, "assistant", "y"),
    (21, 0, "user", "only turn"), (22, 0, "user", "only turn"), (23, 0, "user", "only turn"), (24, 0, "user", "only turn"), (None, 0, "user", "nobody"), (None, None, None, None),
    (2**60 + 1, 5, "us", "er"), (2**60 + 3, 5, "user", ""), (45, 0, "user", "word " * 20_000), (46, 0, "user", "word " * 20_000),
]


@pytest.mark.parametrize("block", [0, 20])
def test_edge_rows_and_empty_table(make_turns, block):
    assert found(prefix_trie.prefix_trie(make_turns(EDGES), block)) == brute(EDGES, block)
    assert prefix_trie.prefix_trie(make_turns([]), block).count() == 0


@pytest.mark.parametrize("group_turns", [0, 15, 50_000])
def test_bands_of_any_size_equal_brute_force(make_turns, group_turns):
    rows = random_turns(4)
    assert found(prefix_trie.prefix_trie(make_turns(rows), 20, group_turns)) == brute(rows)


def test_small_conversations_equal_brute_force_and_sql(spark, small):
    folder = "/root/testdata/sf0.001"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in small("conversations").collect()]
    own = found(op12_prefix_trie(spark, folder))
    assert own == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    sql = con.execute(prefix_trie.oracle(20))
    assert [c[0] for c in sql.description] == op12_prefix_trie(spark, folder).columns
    assert sorted(sql.fetchall(), key=repr) == own


def test_many_copies_and_ranges_of_ids(make_turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_RANGE", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(40) for t in range(3)]
    nodes = found(prefix_trie.prefix_trie(make_turns(rows)))
    assert nodes == brute(rows, 0) and [n[3] for n in nodes] == [40] * 4
    assert sorted(n[7] != EMPTY for n in nodes) == [False, False, False, True]
