"""Line dedup across the corpus by a deletion-neighbourhood join over words.

Two lines are near-equal if one word edit (a word replaced, inserted or left out) turns one into the
other; lines are compared as their words joined by single blanks. Every line's neighbourhood is all
its variants with one word left out, as hashed keys:

* lines of n words that share the variant without word i differ in word i only, and
* a line that equals a variant of another is that line with one word more or less.

In both joins every member of a group is within the bound of the group's first member on the other
side, so a minimum per key replaces pairs, however large a group is. Links are verified by the edit
distance of the words themselves; the earliest line within the bound is kept.

Exact copies are collapsed first. Variants are emitted only for lines that can have a partner: one
word edit leaves the first or the last half of the words as they were, so a line none of whose halves
occurs in another line is left out of the neighbourhood, without loss.

Earlier means: smaller doc_id, NULL ids last, then the row, then the line number. A line is dropped if
an earlier one within the bound exists, be that one dropped or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.llm.common import blank, fresh, staged, text_batches
from shiftlab.operators.scale import dimension

# Lines with fewer words than this have exact copies only: one word in few is not a small edit.
NEAR_WORDS = 8
SIGNED = 1 << 63
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
# Lists of lines per document are sent to all executors up to this size, beyond it they are shuffled.
LOOKUP_BYTES = 50_000_000


def hashed(words: list[str], seed: int = 0) -> int:
    """A signed 64-bit hash of words joined by blanks."""
    value = xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"), seed)
    return value - (1 << 64) if value >= SIGNED else value


def half_keys(words: list[str]) -> list[int]:
    """Keys of the first and last halves, as a line of n words and as one of n - 1 with a word more."""
    n = len(words)
    return [k for m in {n // 2, (n - 1) // 2} for k in (hashed(words[:m], 1), hashed(words[n - m :], 2))]


def variant_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of all variants with one word left out: with its place, without, and that of the line itself.

    A variant's hash is a polynomial over its words' hashes, built from prefix sums: linear in the line.
    """
    w = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in words], np.uint64)
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(w) - 1, BASE, np.uint64), dtype=np.uint64)])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * powers, dtype=np.uint64)])
    variants = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(BASE_INVERSE)
    places = np.arange(len(w), dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(len(w))
    return _mixed(variants, places), np.unique(_mixed(variants, np.uint64(0))), int(_mixed(sums[-1:], np.uint64(0))[0])


def _mixed(x: np.ndarray, salt) -> np.ndarray:
    x = x ^ (salt * np.uint64(0xD6E8FEB86659FD93))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def within_one_edit(a: list[str], b: list[str]) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


# --- reading lines ------------------------------------------------------------------------------


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line with a word: its row, hash, number of words and half keys."""
    for batch in batches:
        columns: list[list] = [[] for _ in range(5)]
        taken = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for number, line in enumerate(text.split("\n")):
                words = line.split()
                if words:
                    taken.append(i)
                    halves = half_keys(words) if len(words) >= NEAR_WORDS else []
                    for column, value in zip(columns, (number, hashed(words), len(words), halves)):
                        column.append(value)
        at = pa.array(taken, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("row").take(at), batch.column("key").take(at), pa.array(columns[0], pa.int32()),
             pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(pa.int64()))],
            names=["doc_id", "row", "key", "line", "h", "n", "halves"],
        )


def _chosen_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of the wanted lines of each document, as one string."""
    for batch in batches:
        found = []
        for text, numbers, hashes in zip(batch["text"], batch["lines"], batch["hashes"]):
            lines = text.split("\n")
            for number, h in zip(numbers, hashes):
                words = lines[number].split() if number < len(lines) else []
                if words and hashed(words) == h:
                    found.append((h, " ".join(words)))
        yield pd.DataFrame(found, columns=["h", "words"])


def _neighbourhood(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of a line's neighbourhood; role 0: with place, 1: without place, 2: the line itself."""
    for batch in batches:
        lines, keys, roles, size = [], [], [], 0
        for h, words in zip(batch["h"], batch["words"]):
            placed, plain, own = variant_keys(words.split(" "))
            for role, part in enumerate((placed, plain, [own])):
                lines.append(np.full(len(part), h, np.int64))
                keys.append(np.asarray(part, np.int64))
                roles.append(np.full(len(part), role, np.int8))
                size += len(part)
            if size >= 200_000:
                yield _rows(lines, keys, roles)
                lines, keys, roles, size = [], [], [], 0
        if lines:
            yield _rows(lines, keys, roles)


def _rows(lines: list[np.ndarray], keys: list[np.ndarray], roles: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"h": np.concatenate(lines), "key": np.concatenate(keys), "role": np.concatenate(roles)})


@F.pandas_udf(T.BooleanType())
def _verified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([within_one_edit(x.split(" "), y.split(" ")) for x, y in zip(a, b)], dtype=bool)


# --- the operator -------------------------------------------------------------------------------


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per dropped line: its document, row and number, the kept line's, and the word edits (0, 1).

    ``row`` names a column that numbers the rows of ``docs``; without it rows are numbered as read.
    Lines are those between line feeds, numbered from 0; a line without a word is never dropped, and
    NULL texts have none. Rows that repeat a doc_id are told apart by their row: the later row's lines
    are dropped. Other columns are ignored; no documents, no rows.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    # Texts are found again by what they hold, whatever their ids and however rows are numbered.
    source = docs.select(F.col(doc_id).alias("doc_id"), number.cast("long").alias("row"), F.xxhash64(blank(text)).alias("key"), blank(text).alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    text_batches(docs.sparkSession)
    read = source.mapInArrow(_read_lines, f"doc_id {kind}, row long, key long, line int, h long, n int, halves array<long>")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "line", "key")
    lines = staged(read.select(place.alias("place"), "h", "n", "halves"), "lines")

    distinct = staged(
        lines.groupBy("h", "n").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("halves").alias("halves")),
        "distinct-lines",
    )
    near = _near_partners(source.select("key", "text"), distinct)
    best = (
        distinct.where("copies > 1").select("h", "n", "first", F.lit(None).cast(dict(distinct.dtypes)["first"]).alias("partner"))
        .unionByName(near)
        .groupBy("h", "n").agg(F.min("first").alias("first"), F.min("partner").alias("partner"))
        .select("h", "n", "first", F.least("first", "partner").alias("kept"))
    )
    # Written first: a join of two plain shuffles is one whose hot lines adaptive execution can split.
    best = staged(best, "best-lines")
    return (
        lines.select("place", "h", "n").join(best, ["h", "n"]).where("place > kept")
        .select(
            "place.doc_id", "place.row", "place.line", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line").alias("kept_line"),
            F.when(F.col("kept") == F.col("first"), 0).otherwise(1).alias("edits"),
        )
    )


def _near_partners(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """h, n, first and the earliest verified partner of each distinct line that has an earlier one."""
    keys = distinct.where(F.size("halves") > 0).select("h", F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half")
    able = keys.join(shared, "half", "left_semi").select("h").distinct()
    lines = staged(distinct.join(able, "h", "left_semi").where(F.size("halves") > 0).select("h", "n", "first"), "able-lines")

    # Second reading of the texts that hold the first copies of these lines.
    wanted = lines.groupBy(F.col("first.key").alias("key")).agg(F.collect_list("first.line").alias("lines"), F.collect_list("h").alias("hashes"))
    wanted = dimension(staged(wanted, "wanted-lines"), LOOKUP_BYTES)
    held = texts.join(wanted, "key").select("text", "lines", "hashes")
    # A text that several rows repeat gives its lines once.
    words = held.mapInPandas(_chosen_lines, "h long, words string").groupBy("h").agg(F.min("words").alias("words"))
    words = staged(words.join(lines, "h"), "worded-lines")

    keyed = words.select("h", "words").mapInPandas(_neighbourhood, "h long, key long, role byte").join(lines.select("h", "first"), "h")
    variants = staged(keyed, "variants")
    own, line = F.col("role") < 2, F.col("role") == 2
    # Written first, as the lines above: then hot variants can be split.
    groups = staged(variants.groupBy("key").agg(
        F.min(F.when(F.col("role") == 0, F.col("first"))).alias("same"),
        F.min(F.when(F.col("role") == 1, F.col("first"))).alias("longer"),
        F.min(F.when(line, F.col("first"))).alias("shorter"),
        F.count(F.lit(1)).alias("members"),
    ).where("members > 1"), "variant-groups")
    partner = F.when(F.col("role") == 0, F.col("same")).when(own, F.col("shorter")).otherwise(F.col("longer"))
    links = variants.join(groups, "key").select("h", "first", partner.alias("partner")).where("partner < first")
    earliest = links.groupBy("h").agg(F.min("partner").alias("partner"))
    pairs = earliest.join(words, "h").join(
        words.select(F.col("first").alias("partner"), F.col("words").alias("other")), "partner"
    )
    return pairs.where(_verified("words", "other")).select("h", "n", "first", "partner")


def without_duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, without their dropped lines.

    A document that loses all its lines goes, one that had no line with a word stays as it is.
    Documents are written to the shared folder once, so that their rows keep their numbers.
    """
    row, gone = fresh(docs, "row"), fresh(docs, "gone")
    own = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    dropped = duplicate_lines(own, doc_id, text, row)
    lists = dropped.groupBy(F.col("row").alias(row)).agg(F.collect_set("line").alias(gone))
    lists = dimension(staged(lists, "dropped-lines"), LOOKUP_BYTES)
    left = F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains(F.col(gone), i))
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    joined = own.join(lists, row, "left").withColumn(text, kept)
    return joined.where(F.col(gone).isNull() | F.col(text).rlike(r"\S")).select(*docs.columns)


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS number
  FROM documents
), worded AS (
  SELECT doc_id, number, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS words FROM lines
), placed AS (
  SELECT doc_id, number, words, len(words) AS n, array_to_string(words, ' ') AS norm,
         doc_id * 1000000 + number AS place
  FROM worded WHERE len(words) > 0
), firsts AS (
  SELECT norm, any_value(words) AS words, any_value(n) AS n, min(place) AS first FROM placed GROUP BY norm
), variants AS (
  SELECT norm, n, first, i, array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ') AS variant
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= {NEAR_WORDS})
), replaced AS (
  SELECT norm, min(first) OVER (PARTITION BY n, i, variant) AS partner FROM variants
), pairs AS (
  SELECT v.norm AS longer, s.norm AS shorter, v.first AS longer_first, s.first AS shorter_first
  FROM variants v JOIN firsts s ON v.variant = s.norm WHERE s.n >= {NEAR_WORDS}
), best AS (
  SELECT norm, min(partner) AS kept FROM (
    SELECT norm, first AS partner FROM firsts
    UNION ALL SELECT norm, partner FROM replaced
    UNION ALL SELECT longer, shorter_first FROM pairs
    UNION ALL SELECT shorter, longer_first FROM pairs
  ) GROUP BY norm
)
SELECT p.doc_id, CAST(p.number AS INTEGER) AS line, b.kept // 1000000 AS kept_doc_id,
       CAST(b.kept % 1000000 AS INTEGER) AS kept_line, CASE WHEN b.kept = f.first THEN 0 ELSE 1 END AS edits
FROM placed p JOIN best b USING (norm) JOIN firsts f USING (norm) WHERE p.place > b.kept
"""
