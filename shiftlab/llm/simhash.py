"""SimHash near-duplicates through vantage-point trees.

Every text gets a 64-bit fingerprint of its word shingles; fingerprints that differ in few bits are
linked, and documents are grouped by the connected components of these links.

Links are found by vantage-point trees over the fingerprints' halves. Of two fingerprints at distance
r or less, one half differs in r // 2 bits or fewer, so a tree over each half with that radius finds
all pairs; the narrow radius is what keeps the overlap of the shards small. A node of a tree holds a
vantage point v and a bound mu. Points with d(v, x) > mu go to the outer side, points with
d(v, x) <= mu + radius to the inner one. By the triangle inequality a pair within the radius always
meets on one side: either both are beyond mu, or one is within mu and the other within mu + radius.
Points in the overlap go to both. The leaves are the shards of a Spark shuffle; inside a shard the
exact distances of the whole fingerprints decide, again pruned by vantage points. A shard returns a
star per local component, never its pairs.

The trees are fitted on a bounded sample of the distinct fingerprints (``SAMPLE``); they only route.
Every distinct fingerprint is indexed, and all pairs are found whatever the sample was. Shards that hold
too many points all the same, because there are more of them than a sample can deal or because very many
share a half, are split on: each round gives every such shard a vantage point of its own over its half. Where
none parts its points they go on twice, over the two quarters of the other half, by the same reasoning.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.llm.common import blank, fresh, staged, text_batches
from shiftlab.llm.components import components
from shiftlab.llm.windows import HASH_RANGE
from shiftlab.operators.scale import dimension

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
SAMPLE = 65_536
SHARD_POINTS = 4_096
# A shard over this many times SHARD_POINTS is split on, by a vantage point chosen among so many of its points.
LARGE_SHARD = 4
CHOICE_POINTS = 2_048
# A split must leave no more than this share of the pairs to compare: then overlaps cannot outgrow what splits save.
PAIRS_LEFT = 0.9
MAX_SPLITS = 40
# The bits each tree measures: a tree per half, and two per half over its quarters.
TREES = (0xFFFFFFFF, 0xFFFFFFFF << 32, 0xFFFF, 0xFFFF << 16, 0xFFFF << 32, 0xFFFF << 48)
HASH_BLOCK = 65_536
DROPPED_BYTES = 50_000_000


# --- fingerprints -------------------------------------------------------------------------------


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of one whole text, an unsigned 64-bit integer; 0 without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = [e - 1 for e in accumulate(len(t) + 1 for t in tokens)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(tokens) - words + 1
    for a in range(0, n, HASH_BLOCK):
        pairs = zip(starts[a : min(a + HASH_BLOCK, n)], ends[a + words - 1 :])
        hashes = np.array([digest(joined[i:j], SEED) for i, j in pairs], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        values = np.array([fingerprint(t or "") for t in texts], np.uint64)
        yield pd.Series(values.view(np.int64))


def with_fingerprint(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint as a long (its 64 bits) in a column ``name``; NULL text is empty."""
    text_batches(docs.sparkSession)
    return docs.withColumn(name, _fingerprints(blank(text)))


# --- vantage-point trees ------------------------------------------------------------------------


def distance(points: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(points ^ point)


def _choose(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int, np.ndarray] | None:
    """A vantage point and bound whose larger side is smallest; None if no split saves a tenth."""
    best = None
    probe = points if len(points) <= 2048 else rng.choice(points, 2048, replace=False)
    for v in rng.choice(points, min(6, len(points)), replace=False):
        counts = np.bincount(distance(probe, v), minlength=66)
        below = np.cumsum(counts)
        for mu in range(64):
            larger = max(below[min(mu + radius, 65)], len(probe) - below[mu])
            if best is None or larger < best[0]:
                best = (larger, v, mu)
    if best is None or best[0] > 0.9 * len(probe):
        return None
    return int(best[1]), best[2], distance(points, best[1])


def _fewest_pairs(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """A vantage point and bound whose sides hold the fewest pairs; None if more than ``PAIRS_LEFT`` remain."""
    best = (PAIRS_LEFT * len(points) ** 2, None)
    for v in rng.choice(points, min(32, len(points)), replace=False):
        below = np.cumsum(np.bincount(distance(points, v), minlength=66 + radius))
        inner, outer = below[radius : 64 + radius], len(points) - below[:64]
        pairs = inner**2 + outer**2
        mu = int(pairs.argmin())
        if pairs[mu] <= best[0] and max(inner[mu], outer[mu]) < len(points):
            best = (int(pairs[mu]), (int(v), mu))
    return best[1]


def grow(points: np.ndarray, radius: int, leaf: int, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """A tree as rows (vantage point, bound, inner, outer); a leaf has bound -1."""
    rng, nodes, todo = np.random.default_rng(seed), [None], [(0, np.unique(points))]
    while todo:
        at, part = todo.pop()
        split = _choose(part, radius, rng) if len(part) > leaf else None
        if split is None:
            nodes[at] = (0, -1, 0, 0)
            continue
        v, mu, d = split
        nodes[at] = (v, mu, len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(len(nodes) - 2, part[d <= mu + radius]), (len(nodes) - 1, part[d > mu])]
    return nodes


def route(nodes: list, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """The leaves that hold each point, as (leaf, positions of its points)."""
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        v, mu, inner, outer = nodes[at]
        if not len(rows):
            continue
        if mu < 0:
            yield at, rows
            continue
        d = distance(points[rows], points.dtype.type(v))
        todo += [(inner, rows[d <= mu + radius]), (outer, rows[d > mu])]


def halves(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (prints & np.uint64(0xFFFFFFFF)).astype(np.uint32), (prints >> np.uint64(32)).astype(np.uint32)


def local_roots(prints: np.ndarray, max_bits: int, leaf: int = 1024) -> np.ndarray:
    """For each of the distinct prints of a shard, the position of its local component's root."""
    root = np.arange(len(prints))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    rng, todo = np.random.default_rng(len(prints)), [np.arange(len(prints))]
    while todo:
        rows = todo.pop()
        split = _choose(prints[rows], max_bits, rng) if len(rows) > leaf else None
        if split is not None:
            _, mu, d = split
            todo += [rows[d <= mu + max_bits], rows[d > mu]]
            continue
        own = prints[rows]
        for a in range(0, len(rows), 256):
            near = np.bitwise_count(own[a : a + 256, None] ^ own[None, : a + 256]) <= max_bits
            for i in np.flatnonzero(near.sum(axis=1) > 1):
                group = {find(x) for x in np.unique(root[rows[np.flatnonzero(near[i])]])} | {find(rows[a + i])}
                least = min(group)
                for x in group:
                    root[x] = least
    return np.array([find(i) for i in range(len(prints))])


# --- links and components -----------------------------------------------------------------------


def links(prints: DataFrame, max_bits: int = MAX_BITS, sample: int = SAMPLE, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Edges a, b between the distinct fingerprints (column fp) that connect all pairs within the bound.

    ``prints`` is read several times and should be a stored table.
    """
    total = prints.count()
    share = min(1.0, sample / max(total, 1))
    # A hash of the fingerprint picks the sample: the same rows whatever the partitioning.
    picked = prints.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(HASH_RANGE)) < int(share * HASH_RANGE))
    points = picked.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    radius, leaf = max_bits // 2, max(32, int(shard_points * share))
    trees = [grow(half, radius, leaf, seed) for seed, half in enumerate(halves(points), 7)]

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["fp"].to_numpy(np.int64)
            for tree, half in zip(range(2), halves(own.view(np.uint64))):
                for at, rows in route(trees[tree], half, radius):
                    yield pd.DataFrame({"tree": np.int32(tree), "shard": np.int64(at), "fp": own[rows]})

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(pdf["fp"].to_numpy(np.int64))
        roots = local_roots(own.view(np.uint64), max_bits)
        other = roots != np.arange(len(own))
        return pd.DataFrame({"a": own[other], "b": own[roots[other]]})

    # A stored table of fingerprints is small and has few files: routing is work, so it is dealt to all cores.
    context = prints.sparkSession.sparkContext
    cores = max(context.defaultParallelism, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = prints.select("fp").repartition(cores, "fp").mapInPandas(shards, "tree int, shard long, fp long")
    dealt = split_on(staged(dealt.withColumn("level", F.lit(0)), "routed"), max_bits, LARGE_SHARD * shard_points)
    return dealt.groupBy("tree", "level", "shard").applyInPandas(stars, "a long, b long")


def split_on(routed: DataFrame, max_bits: int, most: int) -> DataFrame:
    """The stored table of routed points (tree, level, shard, fp) with shards over ``most`` points split.

    Every round splits each of them once more, until all fit or no vantage point parts the rest. Points
    stay in Spark; of a shard about ``CHOICE_POINTS`` reach the task that chooses.
    """
    radius = max_bits // 2

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        own, tree = np.sort(pdf["fp"].to_numpy(np.int64)).view(np.uint64), int(pdf["tree"].iloc[0])
        mask = np.uint64(TREES[tree])
        found = _fewest_pairs(own & mask, radius, np.random.default_rng(len(own)))
        out = pdf[["tree", "shard"]].iloc[:1]
        if found is not None:
            v, mask = np.array([found[0], mask], np.uint64).view(np.int64)
            return out.assign(v=v, mask=mask, mu=found[1], quarters=-1)
        # A half that does not part them: the first quarter of the other half.
        return out.assign(v=0, mask=0, mu=0, quarters=4 - 2 * tree) if tree < 2 else out.iloc[:0].assign(v=0, mask=0, mu=0, quarters=0)

    done: list[DataFrame] = []
    key = ["tree", "shard"]
    for level in range(1, MAX_SPLITS + 1):
        sizes = routed.groupBy(*key).agg(F.count(F.lit(1)).alias("points")).where(F.col("points") > most)
        sizes = staged(sizes, "large-shards")
        if sizes.isEmpty():
            break
        drawn = F.pmod(F.xxhash64("fp", F.lit("choice")), F.lit(HASH_RANGE)) < F.lit(CHOICE_POINTS * HASH_RANGE) / F.col("points")
        vantage = routed.join(sizes, key).where(drawn).select(*key, "fp").groupBy(*key).applyInPandas(
            choose, "tree int, shard long, v long, mask long, mu int, quarters int"
        )
        vantage = staged(vantage, "vantage-points")
        if vantage.isEmpty():
            break
        done.append(routed.join(vantage.select(*key), key, "left_anti"))

        def side(tree: Column, number: int) -> Column:
            return F.struct(tree.cast("int").alias("tree"), (F.col("shard") * 2 + number).alias("shard"))

        d = F.bit_count(F.col("fp").bitwiseXOR(F.col("v")).bitwiseAND(F.col("mask")))
        split, same = F.col("quarters") < 0, F.col("tree")
        inner = F.when(~split, side(F.col("quarters"), 0)).when(d <= F.col("mu") + radius, side(same, 0))
        outer = F.when(~split, side(F.col("quarters") + 1, 1)).when(d > F.col("mu"), side(same, 1))
        parts = routed.join(vantage, key).select("fp", F.explode(F.array_compact(F.array(inner, outer))).alias("to"))
        routed = staged(parts.select("to.tree", F.lit(level).alias("level"), "to.shard", "fp"), "split")
    return reduce(DataFrame.unionByName, [part.select("tree", "level", "shard", "fp") for part in [*done, routed]])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    NULL texts count as empty, all texts without a word share fingerprint zero and are linked. A
    repeated row is returned as often as it comes. Documents without an id take part;
    component_id is the smallest id of the component that is not NULL. Other columns are ignored.
    No document gives no row.
    """
    own = staged(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "fp", "text").drop("text"), "prints")
    return own.join(classes(own, max_bits), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def classes(own: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """root (a fp) and component_id for every distinct fp of a stored table with columns doc_id and fp."""
    first = staged(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
    groups = components(links(first, max_bits)).select(F.col("node").alias("fp"), "root")
    grouped = first.join(groups, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return grouped.join(least, "root").select("fp", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, with one row kept of each near-duplicate group.

    The row with the smallest id stays (of rows that repeat an id, one; a group without any id keeps
    one row too). Documents are written to the shared folder once with their fingerprints, so that
    texts are fingerprinted once.
    """
    fp, row = fresh(docs, "fp"), fresh(docs, "row")
    own = staged(with_fingerprint(docs, fp, text).withColumn(row, F.monotonically_increasing_id()), "printed")
    keys = own.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    grouped = keys.join(classes(keys.select("doc_id", "fp")), "fp")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = grouped.groupBy("root").agg(F.min(order)["row"].alias("kept"))
    dropped = grouped.join(kept, F.col("row") == F.col("kept"), "left_anti").select(F.col("row").alias(row))
    # Sent to all executors while it is small: then the texts are not shuffled.
    dropped = dimension(staged(dropped, "dropped-rows"), DROPPED_BYTES)
    return own.join(dropped, row, "left_anti").select(*docs.columns)
