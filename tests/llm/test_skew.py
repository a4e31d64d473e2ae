"""Hot keys: the joins that meet them are split by adaptive execution, and lookups stay linear."""

import pytest
from pyspark.sql import functions as F

from shiftlab.llm import components, lines, secrets
from shiftlab.llm.common import staged

SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def split(spark, monkeypatch):
    """Low bounds of what is a skewed partition; the final plans of all staged tables, by their names."""
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    plans = {}

    def watched(df, name):
        # The same query once more, for its final plan.
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    for key, value in SPLIT.items():
        spark.conf.set(key, value)
    for module in (components, secrets, lines):
        monkeypatch.setattr(module, "staged", watched)
    yield plans
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_huge_star_is_split(spark, split):
    leaves = spark.range(1, 40_001, 1, 16).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    chain = spark.range(50_000, 50_400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.components(leaves.unionByName(chain))
    assert found.where("node <= 40000 and root = 0").count() == 40_001 and found.where("root = 50000").count() == 401
    assert any("skew=true" in p for p in split["edges"])


def test_a_value_of_half_of_all_rows_is_split(spark, split, tmp_path):
    key = "token = 'abcdefabcdef0123456789'"
    docs = spark.range(0, 20_000, 1, 16).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"),
        F.when(F.col("id") % 2 == 0, F.lit(key)).otherwise(F.concat(F.lit("token = 'zzzzzzzzzzzzzz"), F.col("id"), F.lit("'"))).alias("text"),
    )
    docs.write.parquet(str(tmp_path / "docs"))
    found = secrets.scan(spark.read.parquet(str(tmp_path / "docs")))
    rows = found.collect()
    assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 20_000 and sum(r["n_example"] > 0 for r in rows) == 10_000


def test_documents_without_ids_are_looked_up_once_each(spark, make_docs, monkeypatch):
    shared = [f"a passage of more than eight words that some documents share, number {k}" for k in range(300)]
    docs = make_docs([(None, f"{shared[i % 300]}\n{shared[i % 300]} again {i}\nonly here {i}") for i in range(600)])
    checked = []
    plain = lines._chosen_lines

    def counted(batches):
        for batch in batches:
            yield from plain(iter([batch]))

    def looked_up(df, name):
        out = staged(df, name)
        if name == "wanted-lines":
            checked.append(out.agg(F.sum(F.size("lines")), F.count("*"), F.max(F.size("lines"))).first())
        return out

    monkeypatch.setattr(lines, "_chosen_lines", counted)
    monkeypatch.setattr(lines, "staged", looked_up)
    dropped = lines.duplicate_lines(docs).collect()
    wanted, texts, most = checked[0]
    # Every wanted line belongs to the one text that holds it first.
    assert wanted > 600 and texts > 300 and most <= 3 and len(dropped) >= 300
