"""Secret scans with corpus-wide ownership.

Base findings are assignments of passwords and tokens, access key ids and long hexadecimal strings.
The method adds unnamed tokens: long strings of letters and digits with high entropy. Every candidate
value is hashed, and over the whole corpus the distinct repositories and owners that hold it are
counted. A value with many owners is an example that people copy; a value with one owner looks live.
Unnamed tokens are reported only if they look live.

In a documents table a document stands for the repository and its source for the owner.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlab.llm.common import blank, staged, text_batches

# The base patterns. Letters of the keywords stand in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ASSIGN_LEAST = 12
# Runs that reach the least length are whole matches of the base pattern; shorter ones fail anyway.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# The added kind: an unnamed token.
UNNAMED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
UNNAMED_BITS = 3.5
KINDS = ("assign", "access", "hex", "unnamed")
EXAMPLE_OWNERS = 3


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values())


def find(text: str) -> list[tuple[int, int, int, int]]:
    """All candidates of a text as (start, rank of the kind, end, hash of the value), by start and kind."""
    found = []
    folded = text.lower()
    if any(w in folded for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append((m.start(), 0, m.end(), m.group(2)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    base = sorted((s, e) for s, _, e, _ in found)
    for m in UNNAMED.finditer(text):
        value = m.group()
        mixed = any(map(str.isdigit, value)) and any(map(str.isalpha, value))
        free = all(m.end() <= s or e <= m.start() for s, e in base)
        if mixed and free and entropy(value) >= UNNAMED_BITS:
            found.append((m.start(), 3, m.end(), value))
    return [(s, k, e, xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")) - (1 << 63)) for s, k, e, v in sorted(found)]


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[dict(zip(("start", "kind", "end", "value"), span)) for span in find(t)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(SPAN))], names=["row", "found"])


def ownership(candidates: DataFrame) -> DataFrame:
    """For every value its distinct repositories and owners; a NULL one counts as one of its own.

    Copies are removed before the values meet, on each task and then per (value, owner), so a value
    that half the corpus carries is no hot group.
    """
    pairs = candidates.select("value", "repository", "owner").distinct()
    return pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(
        F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners")
    )


def _text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str | None = None, owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per document: counts of the base kinds, base and all spans, values by ownership.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_shared (candidates of one
    owner, of ``example_owners`` or more, and between). ``repository`` is a column, by default the doc_id.
    NULL texts are empty; repeated rows are reported each and are one repository; other columns are
    ignored; an empty table gives no row.
    """
    text_batches(docs.sparkSession)
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(repository or doc_id).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"),
        blank(text).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    found = "array<struct<start:int,kind:int,end:int,value:long>>"
    keys = source.select(F.struct("doc_id", "repository", "owner", "row").alias("row"), "text")
    row_type = keys.schema["row"].dataType.simpleString()
    # The scanned table is small: a few spans per document instead of its text.
    scanned = staged(keys.mapInArrow(_scan, f"row {row_type}, found {found}").select("row.*", "found"), "secret-candidates")
    candidates = scanned.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("c")).select("row", "repository", "owner", "c", "c.value")
    # Written first: a join of two plain shuffles is one whose hot values adaptive execution can split.
    judged = candidates.join(staged(ownership(candidates), "ownership"), "value")
    live, example = F.col("owners") == 1, F.col("owners") >= example_owners
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when(live & (F.col("c.kind") == 3), F.struct("c.start", "c.kind", "c.end", "c.value"))).alias("added"),
        F.count(F.when(live, 1)).alias("n_live"),
        F.count(F.when(example, 1)).alias("n_example"),
        F.count(F.when(~live & ~example, 1)).alias("n_shared"),
    )
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    every = F.array_sort(F.concat(base, F.coalesce("added", F.array().cast(found))))
    return scanned.join(by_row, "row", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_text(base), 256).alias("base_sha256"), _text(every).alias("spans"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_example", "n_shared")),
    )
