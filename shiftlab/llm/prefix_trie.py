"""The trie of conversation prefixes by truncation peeling.

A conversation is a sequence of turns, a node a distinct sequence of first turns. Every turn has a
digest, every prefix a key that chains the digests of its turns, so equal prefixes have equal keys
wherever they stand and a conversation carries the keys of all its prefixes.

Peeling descends from the deepest nodes. At depth d the nodes that survived from below meet the
conversations that end at d; they are regrouped by the key of their first d turns, which yields the
nodes of that depth with all that is known of their subtrees: members, children, leaves, saved tokens.
Their last turn is then stripped, which makes them the survivors of depth d - 1. So nodes are discovered
and aggregated in one pass, and each is shuffled as one row however many conversations share it.

Equal conversations are collapsed before the first level. Several depths are peeled in one Spark job
where this is safe: grouped by the key of the band's topmost depth, every group holds whole subtrees,
and if none has more than ``GROUP_TURNS`` turns (it is measured) the task peels each group on its own.
Otherwise the band is halved; a band of one depth is a plain aggregate with map-side combine, which no
hot prefix can overload. Every band is written to the shared folder before the next.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlab.llm.common import staged, text_batches

GROUP_TURNS = 50_000
ID_RANGE = 65_536  # ids whose list is gathered in one row
WORD = r"[^\x20\x09-\x0D]+"
STATE = "key binary, parent binary, depth int, conv_id long, n long, children long, leaves long, saved long, keys array<binary>, words array<int>"


def turn_digest(role: str = "role", text: str = "text"):
    """A digest of a turn as hex digits; role and text cannot run into each other."""
    own, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return F.md5(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own, said).cast("binary"))


def heads(conv_id: int) -> int:
    """How many first turns a conversation takes from the first one of its block: 0 to 3."""
    return zlib.crc32(str(conv_id).encode()) % 4


def paths(conversations: DataFrame, block: int = 0) -> DataFrame:
    """conv_id, keys, words: for every conversation the keys of its prefixes and the words of its turns.

    Turns are ordered by ``turn``, NULL first, equal ones by their digest; a NULL role or text is empty;
    turns without a conversation are no one's. With ``block`` every conversation c is rebuilt first: its
    first ``heads(c)`` turns give way to as many of conversation ``c - c % block``, as far as there are any.
    """
    text_batches(conversations.sparkSession)
    own = F.col("conv_id").cast("long")
    first = own - own % block if block else own
    turns = conversations.where("conv_id is not null").select(
        first.alias("first"), own.alias("conv_id"), F.col("turn").alias("turn"), F.unhex(turn_digest()).alias("digest"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).alias("n"),
    )
    # Conversations are cut out of sorted rows one by one; the one that gives the first turns leads its block.
    order = turns.repartition("first").sortWithinPartitions("first", F.col("conv_id") != F.col("first"), "conv_id", F.col("turn").asc_nulls_first(), "digest")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple = (None, [])
        rows: list[tuple] = []
        for (start, conv), turns in groupby(_rows(batches, "first", "conv_id", "digest", "n"), key=lambda r: r[:2]):
            said = [r[2:] for r in turns]
            if block:
                if conv == start:
                    head = (start, said[:3])
                lent = head[1] if head[0] == start else []
                said = lent[: heads(conv)] + said[heads(conv) :]
            keys, key = [], b""
            for digest, _ in said:
                key = hashlib.md5(key + digest).digest()
                keys.append(key)
            rows.append((conv, keys, [n for _, n in said]))
            if len(rows) >= 1_000 or len(keys) >= 10_000:
                yield _batch(rows, "conv_id", "keys", "words")
                rows = []
        if rows:
            yield _batch(rows, "conv_id", "keys", "words")

    return order.select("first", "conv_id", "digest", "n").mapInArrow(chain, "conv_id long, keys array<binary>, words array<int>")


ARROW = {
    "conv_id": pa.int64(), "keys": pa.list_(pa.binary()), "words": pa.list_(pa.int32()), "key": pa.binary(), "parent": pa.binary(), "depth": pa.int32(),
    "n": pa.int64(), "children": pa.int64(), "leaves": pa.int64(), "saved": pa.int64(), "ends_sha256": pa.string(),
}


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[n]) for n, c in zip(names, zip(*rows))], names=list(names))


# --- peeling ------------------------------------------------------------------------------------


def _key_at(depth: int):
    """The key of the first ``depth`` turns; that of none is empty."""
    return F.element_at("keys", depth) if depth else F.lit(b"")


def _merged(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of one depth from rows that carry exactly their first ``depth`` turns."""
    added = F.col("n") - 1
    parent = F.lit(None).cast("binary") if depth == 0 else _key_at(depth - 1)
    return (
        rows.groupBy(_key_at(depth).alias("key"))
        .agg(
            F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
            F.sum("saved").alias("saved"), F.any_value("keys").alias("keys"), F.any_value("words").alias("words"),
        )
        .select(
            "key", parent.alias("parent"), F.lit(depth).alias("depth"), "conv_id", "n", "children",
            F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"),
            (F.col("saved") + added * F.element_at("words", depth) if depth else F.col("saved")).alias("saved"), "keys", "words",
        )
    )


def _peel(rows: list[tuple], top: int) -> Iterator[tuple]:
    """The nodes of depth ``top`` and more of one group, which is given as ``_PEELED`` rows."""
    ended = defaultdict(list)
    for row in rows:
        ended[len(row[5])].append(row)
    survivors: list[tuple] = []
    for depth in range(max(ended), top - 1, -1):
        level: dict[bytes, list] = {}
        for conv, n, children, leaves, saved, keys, words in [*survivors, *ended[depth]]:
            node = level.setdefault(keys[depth - 1], [conv, 0, 0, 0, 0, keys, words])
            node[0] = min(node[0], conv)
            for i, value in enumerate((n, children, leaves, saved), 1):
                node[i] += value
        survivors = []
        for key, (conv, n, children, leaves, saved, keys, words) in level.items():
            leaves, saved = leaves if children else 1, saved + (n - 1) * words[depth - 1]
            survivors.append((conv, n, 1, leaves, saved, keys, words))
            # Only those of the topmost depth go on; their paths end there.
            path = (keys[:depth], words[:depth]) if depth == top else (None, None)
            yield (key, keys[depth - 2] if depth > 1 else b"", depth, conv, n, children, leaves, saved, *path)


_PEELED = ("conv_id", "n", "children", "leaves", "saved", "keys", "words")
_NODE = ("key", "parent", "depth", "conv_id", "n", "children", "leaves", "saved", "keys", "words")


def _band(rows: DataFrame, top: int) -> DataFrame:
    """The nodes of depth ``top`` and more, each group of rows that share their first ``top`` turns on its own."""
    order = rows.withColumn("group", _key_at(top)).repartition("group").sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for _, members in groupby(_rows(batches, "group", *_PEELED), key=lambda r: r[0]):
            found += _peel([m[1:] for m in members], top)
            if len(found) >= 5_000:
                yield _batch(found, *_NODE)
                found = []
        if found:
            yield _batch(found, *_NODE)

    return order.select("group", *_PEELED).mapInArrow(run, STATE)


def _largest_group(rows: DataFrame, top: int) -> int:
    sizes = rows.groupBy(_key_at(top).alias("group")).agg(F.sum(F.size("keys") - (top - 1)).alias("turns"))
    return sizes.agg(F.coalesce(F.max("turns"), F.lit(0))).first()[0]


def nodes(own: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """All nodes of the trie over ``paths``, a stored table: key, parent, depth, conv_id, n, children, leaves, saved."""
    ended = staged(
        own.groupBy(F.when(F.size("keys") > 0, F.element_at("keys", -1)).otherwise(F.lit(b"")).alias("key"))
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.any_value("keys").alias("keys"), F.any_value("words").alias("words"))
        .select("conv_id", "n", *(F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")), "keys", "words", F.size("keys").alias("depth")),
        "ended-conversations",
    )
    bottom = ended.agg(F.max("depth")).first()[0]
    parts: list[DataFrame] = []
    below = ended.limit(0).select(*_PEELED)
    while bottom is not None and bottom >= 0:
        rows = lambda top: below.unionByName(ended.where(F.col("depth").between(top, bottom)).select(*_PEELED))  # noqa: B023, E731
        # From one depth to the topmost one that keeps all groups small; half the depths, and so on.
        for top in (1, bottom // 2 + 1) if bottom > 0 else ():
            if top < bottom and _largest_group(rows(top), top) <= group_turns:
                part = _band(rows(top), top)
                break
        else:
            top, part = bottom, _merged(rows(bottom), bottom)
        parts.append(staged(part, "trie-nodes"))
        below = parts[-1].where(F.col("depth") == top).select(
            "conv_id", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved",
            *(F.slice(c, 1, max(top - 1, 0)).alias(c) for c in ("keys", "words")),
        )
        bottom = top - 1
    if not parts:
        return own.sparkSession.createDataFrame([], STATE).drop("keys", "words")
    return reduce(DataFrame.unionByName, parts).drop("keys", "words")


def ends(own: DataFrame) -> DataFrame:
    """key and ends_sha256 of every node at which a conversation ends: of their ids, ascending, comma-joined.

    Ids are gathered in ranges of ``ID_RANGE``; a node's ranges are then hashed one after the other as
    they come, so that a node with very many conversations is never held as a whole.
    """
    key = F.when(F.size("keys") > 0, F.element_at("keys", -1)).otherwise(F.lit(b""))
    ranges = (
        own.groupBy(key.alias("key"), F.floor(F.col("conv_id") / ID_RANGE).alias("range"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
        .repartition("key").sortWithinPartitions("key", "range")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for key, members in groupby(_rows(batches, "key", "ids"), key=lambda r: r[0]):
            hashed, comma = hashlib.sha256(), ""
            for _, ids in members:
                hashed.update((comma + ids).encode())
                comma = ","
            found.append((key, hashed.hexdigest()))
            if len(found) >= 5_000:
                yield _batch(found, "key", "ends_sha256")
                found = []
        if found:
            yield _batch(found, "key", "ends_sha256")

    return ranges.select("key", "ids").mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = 0, group_turns: int = GROUP_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is named by its smallest member; saved_tokens are, over its subtree, the words of each node's
    last turn times its members but one. See ``paths`` for NULLs, ties and ``block``. A repeated turn is
    a turn of its own. Other columns are ignored. Without a conversation there is no node, the root included.
    """
    own = staged(paths(conversations, block), "conversation-paths")
    found = nodes(own, group_turns)
    parents = found.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        found.join(ends(own), "key", "left").join(parents, "parent", "left")
        .select(
            "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def _crc32_sql(value: str) -> str:
    """DuckDB SQL for the CRC-32 of a short ASCII text, four bits at a time."""
    table = []
    for v in range(16):
        for _ in range(4):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        table.append(v)
    step = lambda c: f"xor({c} >> 4, list_extract({table}::BIGINT[], ({c} & 15) + 1))"
    codes = f"list_transform(string_split({value}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step(step('xor(c, b)'))}), 4294967295)"


def oracle(block: int) -> str:
    return f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place, digest, words
  FROM (SELECT conv_id, turn, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % {block} AS first, {_crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.place, t.digest, t.words FROM convs c JOIN turns t ON t.conv_id = c.first WHERE t.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.digest, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE t.place > c.h
), prefixes AS (
  SELECT conv_id, words, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS key
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words, CASE WHEN depth > 0 THEN left(key, 32 * (depth - 1)) END AS parent
  FROM prefixes GROUP BY key, depth
), children AS (
  SELECT parent AS key, count(*) AS children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), subtrees AS (
  SELECT left(n.key, 32 * up.depth) AS key, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (WHERE c.key IS NULL) AS leaves
  FROM nodes n LEFT JOIN children c ON c.key = n.key, LATERAL (SELECT unnest(range(0, n.depth + 1)) AS depth) up GROUP BY 1
), ends AS (
  SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(key, depth) AS key FROM prefixes GROUP BY conv_id) GROUP BY key
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(c.children, 0) AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN subtrees s ON s.key = n.key LEFT JOIN children c ON c.key = n.key LEFT JOIN nodes p ON p.key = n.parent LEFT JOIN ends e ON e.key = n.key
"""
