"""Connected components of a graph given by its edges, with stars instead of neighbour lists.

Each round points the neighbours of every node at the smallest of them (first the larger neighbours,
then the smaller ones) until nothing changes: every component is then a star around its smallest
node. A round is two aggregates with map-side combine and two joins against one row per node. These
rows are written before the join, which is then one of two plain shuffles: adaptive execution splits
the many edges of a node with very many neighbours. Every round is written to the shared folder, which
cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm.common import staged

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """For each node, its larger neighbours point at the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return (
        both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """For each node, its smaller neighbours and itself point at the smallest of these neighbours."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = staged(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    others = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns node and root (the smallest node of its component) for every node with an edge.

    ``edges`` has two columns a, b of one ordered type. Self loops and NULL ends are ignored, a
    repeated edge counts once; no edge gives an empty table.
    """
    current = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _mark(current)
    for _ in range(MAX_ROUNDS if seen[0] else 0):
        current = staged(_small_star(staged(_large_star(current), "edges")), "edges")
        now = _mark(current)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and checksums of the edges: two numbers per task reach the driver."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("a", "b") % F.lit(1_000_003)), F.lit(0)).alias("s"),
        F.bit_xor(F.xxhash64("a", "b")).alias("x"),
    ).first()
    return tuple(row)
