"""Sharding by extendible hashing, in DataFrame operations only.

A row's path is a string of bits: 48 of its key's hash, then 48 of its content's, then 48 of its place in
the table. A shard is a prefix of paths. All rows start in the shard with the empty prefix; only a
shard over the byte limit splits on another bit, until every shard fits. So a key whose rows fit
together stays in one shard, a hot key is split by the contents of its rows, and even equal rows are
split by their places. A single row over the limit is a shard of its own.

The directory is found without moving rows: bytes are summed per cell, a prefix some bits longer than
needed on average, with map-side combine; cells are rolled up over shorter prefixes in
bands of a few bits, each from the one below and only as far as some prefix fits, and every cell takes the
shortest one that fits. Only the rows of cells that are still too large (a hot key, or
a very long text beside others) are summed again over further bits.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlab.llm.common import fresh, staged

LIMIT_BYTES = 1 << 20
PART_BITS = 48
PARTS = 3
SLACK_BITS = 4
ROUND_BITS = 12
# Prefix lengths that are summed at once.
BAND_BITS = 4


def bits(*columns: Column) -> Column:
    """48 bits of the hash of columns; NULL differs from an empty string."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns))
    return F.lpad(F.conv(F.substring(F.md5(text), 1, PART_BITS // 4), 16, 2), PART_BITS, "0")


def _rolled_up(cells: DataFrame, least: int, most: int, limit: int) -> DataFrame:
    """For each cell the shortest prefix that fits (NULL if the cell itself is too large)."""
    low = max(least, most - BAND_BITS)
    prefixes = cells.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(low), F.lit(most))).alias("depth"))
    totals = prefixes.groupBy(F.substring("cell", 1, F.col("depth")).alias("shard"), "depth").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    totals = staged(totals, "totals")
    fit = totals.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    # A prefix that fits has only prefixes that fit below it: the shortest one is the shard.
    found = prefixes.select("cell", "depth", F.substring("cell", 1, F.col("depth")).alias("shard")).join(fit, ["shard", "depth"])
    best = found.groupBy("cell").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_docs")).alias("best"))
    shards = cells.select("cell").join(best, "cell", "left")
    # Where nothing of a band's shortest prefixes fits, nothing shorter does.
    if low > least and not fit.where(F.col("depth") == low).isEmpty():
        heads = totals.where(F.col("depth") == low).select(F.col("shard").alias("cell"), F.col("shard_bytes").alias("bytes"), F.col("shard_docs").alias("docs"))
        above = _rolled_up(heads, least, low, limit).where("shard is not null")
        above = above.select(F.col("cell").alias("head"), F.struct("depth", "shard", "shard_bytes", "shard_docs").alias("above"))
        shards = shards.withColumn("head", F.substring("cell", 1, low)).join(above, "head", "left").select("cell", F.coalesce("above", "best").alias("best"))
    return shards.select("cell", "best.*")


def extendible_shards(
    docs: DataFrame, key: list[str], content: list[str], size: Column, limit: int = LIMIT_BYTES
) -> DataFrame:
    """``docs`` with columns shard (its prefix, 0 and 1), depth, row_bytes, shard_bytes and shard_docs.

    ``size`` gives a row's bytes (NULL counts as 0). Columns of these names are replaced. NULL keys are
    a key of their own. ``docs`` is read once per round and should be a stored table: places of rows
    are as read. An empty table gives no row.
    """
    place = F.monotonically_increasing_id()
    parts = [bits(*(F.col(c) for c in key)), bits(*(F.col(c) for c in [*key, *content])), bits(F.col("place"))]
    names = {n: fresh(docs, n) for n in ("path", "cell")}
    added = ["shard", "depth", "row_bytes", "shard_bytes", "shard_docs"]
    others = [c for c in docs.columns if c.lower() not in added]
    rows = docs.withColumns({"row_bytes": F.coalesce(size, F.lit(0)).cast("long")})

    def path(length: int) -> Column:
        return F.concat(*parts[: ceil(max(length, 1) / PART_BITS)])

    total = rows.agg(F.coalesce(F.sum("row_bytes"), F.lit(0))).first()[0]
    depth, step = 0, min(PART_BITS, max(1, ceil(log2(max(total / limit, 1))) + SLACK_BITS))
    rounds: list[tuple[int, DataFrame]] = []
    while True:
        to = min(depth + step, PARTS * PART_BITS)
        placed = rows.withColumn("place", place) if to > 2 * PART_BITS else rows
        open_rows = placed.select(path(to).alias("path"), "row_bytes").select(F.substring("path", 1, to).alias("cell"), "row_bytes")
        if rounds:
            at, table = rounds[-1]
            left = table.where("shard is null").select(F.col("cell").alias("head"))
            open_rows = open_rows.withColumn("head", F.substring("cell", 1, at)).join(left, "head", "left_semi")
        cells = open_rows.groupBy("cell").agg(F.sum("row_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        table = staged(_rolled_up(staged(cells, "cells"), depth + bool(rounds), to, limit), "directory")
        rounds.append((to, table))
        if to == PARTS * PART_BITS or table.where("shard is null").isEmpty():
            break
        depth, step = to, ROUND_BITS

    # A row belongs to the first round whose cell has a shard.
    longest = rounds[-1][0]
    placed = rows.withColumn("place", place) if longest > 2 * PART_BITS else rows
    dealt = placed.withColumn(names["path"], path(longest))
    for i, (to, table) in enumerate(rounds):
        own = table.where("shard is not null").select(F.col("cell").alias(names["cell"]), F.struct("depth", "shard", "shard_bytes", "shard_docs").alias(f"{names['cell']}_{i}"))
        dealt = dealt.withColumn(names["cell"], F.substring(names["path"], 1, to)).join(own, names["cell"], "left")
    best = reduce(F.coalesce, (F.col(f"{names['cell']}_{i}") for i in range(len(rounds))))
    return dealt.select(
        *(F.col(c) for c in others), best["shard"].alias("shard"), best["depth"].alias("depth"), "row_bytes",
        best["shard_bytes"].alias("shard_bytes"), best["shard_docs"].alias("shard_docs"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard under ``path``."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, shard, depth, doc_bytes, shard_bytes and shard_docs of every document, hashed by doc_id.

    A NULL text has no bytes. Documents that repeat an id stay together while they fit the limit.
    """
    own = docs.select("doc_id", "text")
    sharded = extendible_shards(own, ["doc_id"], ["text"], F.octet_length("text"), limit)
    return sharded.select("doc_id", "shard", "depth", F.col("row_bytes").alias("doc_bytes"), "shard_bytes", "shard_docs")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
         lpad(bin(CAST('0x' || substr(md5('=' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT)), 48, '0') AS path
  FROM documents
), prefixes AS (
  SELECT doc_id, bytes, depth, substr(path, 1, depth) AS shard FROM sized, (SELECT unnest(range(0, 49)) AS depth)
), shards AS (
  SELECT depth, shard, sum(bytes) AS shard_bytes, count(*) AS shard_docs FROM prefixes GROUP BY depth, shard
  HAVING sum(bytes) <= {LIMIT_BYTES} OR count(*) = 1
), best AS (
  SELECT p.doc_id, p.bytes, min(p.depth) AS depth FROM prefixes p JOIN shards s USING (depth, shard) GROUP BY p.doc_id, p.bytes
)
SELECT b.doc_id, p.shard, CAST(b.depth AS INTEGER) AS depth, CAST(b.bytes AS BIGINT) AS doc_bytes,
       CAST(s.shard_bytes AS BIGINT) AS shard_bytes, CAST(s.shard_docs AS BIGINT) AS shard_docs
FROM best b JOIN prefixes p ON p.doc_id = b.doc_id AND p.depth = b.depth JOIN shards s ON s.depth = p.depth AND s.shard = p.shard
"""
