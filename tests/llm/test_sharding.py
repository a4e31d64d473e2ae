import hashlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from shiftlab.llm import sharding
from shiftlab.llm.queries import op1_sharding

FOLDER = "/root/testdata/sf0.01"


def brute(rows, limit):
    """The shard of each doc_id, by splitting one bucket at a time."""
    path = lambda i: bin(int(hashlib.md5(f"={i}".encode()).hexdigest()[:12], 16))[2:].zfill(48)
    shards, out = [("", rows)], {}
    while shards:
        prefix, own = shards.pop()
        if sum(n for _, n in own) <= limit or len(own) == 1:
            out |= {i: prefix for i, _ in own}
            continue
        split = defaultdict(list)
        for i, n in own:
            split[path(i)[: len(prefix) + 1]].append((i, n))
        shards += split.items()
    return out


def test_only_oversized_buckets_split(spark, small, small_rows):
    sizes = [(i, len((t or "").encode())) for i, t in small_rows]
    for limit in (3_000, 40_000, 10**9):
        found = {r["doc_id"]: r for r in sharding.shard_documents(small("documents"), limit).collect()}
        assert {i: r["shard"] for i, r in found.items()} == brute(sizes, limit)
        assert all(r["depth"] == len(r["shard"]) for r in found.values())
        assert all(r["shard_bytes"] <= limit or r["shard_docs"] == 1 for r in found.values())


def test_hot_keys_and_equal_rows_are_split_until_they_fit(spark, tmp_path):
    rows = [(7, f"t{i}") for i in range(500)] + [(7, "same") for _ in range(300)] + [(None, "n")] * 40 + [(i, "alone") for i in range(100, 160)] + [(1, "y" * 900), (2, None), (3, "")]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("SHARD", F.lit(1)).write.parquet(path)
    out = sharding.extendible_shards(spark.read.parquet(path), ["doc_id"], ["text"], F.octet_length("text"), 100)
    assert out.columns == ["doc_id", "text", "shard", "depth", "row_bytes", "shard_bytes", "shard_docs"]
    found = out.collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in found) == sorted((i or -1, t or "") for i, t in rows)
    held = defaultdict(list)
    for r in found:
        held[r["shard"]].append(r)
    assert all(sum(r["row_bytes"] for r in s) == s[0]["shard_bytes"] and len(s) == s[0]["shard_docs"] for s in held.values())
    assert all(s[0]["shard_bytes"] <= 100 or len(s) == 1 for s in held.values())
    names = sorted(held)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_edge_rows_and_empty_table(edge_docs, no_docs, tmp_path, spark):
    found = sharding.shard_documents(edge_docs, 60).collect()
    assert len(found) == edge_docs.count()
    assert sharding.shard_documents(no_docs).count() == 0
    sharding.write_shards(sharding.extendible_shards(edge_docs.select("doc_id", "text"), ["doc_id"], ["text"], F.octet_length("text"), 200), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(found)


def test_query_equals_its_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    cursor = connection.execute(sharding.ORACLE)
    columns, wanted = [d[0] for d in cursor.description], cursor.fetchall()
    result = op1_sharding(spark, FOLDER)
    assert result.columns == columns
    assert sorted(map(tuple, result.collect())) == sorted(wanted)


def test_plan_has_no_python(spark):
    plan = op1_sharding(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
