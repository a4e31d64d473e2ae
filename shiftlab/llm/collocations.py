"""Phrase collocations from a weighted de Bruijn graph.

A piece of text is a walk over nodes of two words; an edge is three words, from the node of the first two
to that of the last two, weighted by its occurrences. Only edges and piece ends are counted in the texts.
Everything shorter follows from the flow: a pair of words occurs as often as the weights of its node's
out-edges and the pieces that end with it; a word as often as the pairs it begins and the pieces that end
with it.

A node between an in-edge and an out-edge that both weigh as much as the node is unary: it has no other
edge, and no piece begins or ends there. Paths over unary nodes are compacted by pointer doubling into
one row of words and one weight. Of a path only the two end nodes are looked up; inside it every pair
has the path's weight.

Words travel as 64-bit hashes that include the language. The dictionary back to words is checked: should
two words share a hash, all is hashed anew with another seed. Every task counts its triples in sorted
runs before the shuffle. Triples are shuffled by their node. Nodes that a small sample shows to have a
large share of all triples are dealt to ``SALTS`` partitions; the sample only routes, the counts are the
same whatever it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlab.llm.common import blank, staged, text_batches

LEAST = 10
TOP = 2000
COVER = 50  # per cent
CHUNK_WORDS = 3_000_000
CHUNK_VOCABULARY = 1_000_000
SAMPLE_ROWS = 2_000
HOT_SHARE = 0.001
HOT_LEAST = 1_000
SALTS = 64
MAX_ROUNDS = 60
MIX = np.uint64(0x9E3779B97F4A7C15)
# Letters to lower case, piece separators to line feeds, the other blank to a space.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
TRIPLE = "h1 long, h2 long, h3 long, salt int, n long"


def words(text: str) -> list[bytes]:
    """The words of a text; a line feed ends a piece. Empty strings stand between repeated blanks."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).replace(b"\n", b" \n ").split(b" ")


class LocalWords:
    """Numbers for the words of a task, and their hashes; 0 is the end of a piece."""

    def __init__(self, seed: int):
        self.seed, self.hashes, self.by_lang = seed, [0], {}

    def numbers(self, lang: str, text: str) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
        """The text as numbers, with two zeros at its end; and its words that are new, with their hashes."""
        if lang not in self.by_lang:
            salt = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), self.seed)
            self.by_lang[lang] = (salt, {b"\n": 0, b"": -1})
        salt, known = self.by_lang[lang]
        own, new = words(text), []
        for word in set(own).difference(known):
            known[word] = len(self.hashes)
            h = xxhash.xxh64_intdigest(word, salt) - (1 << 63) or 1
            self.hashes.append(h)
            new.append((h, word))
        found = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
        return np.concatenate([found[found >= 0], np.zeros(2, np.int64)]), new


def _mixed(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (h1.view(np.uint64) * MIX) ^ h2.view(np.uint64)


def _counted(numbers: np.ndarray, hashes: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The distinct triples from each word on with their counts; what is beyond a piece's end is 0."""
    at = np.flatnonzero(numbers[:-2])
    first, second = numbers[at], numbers[at + 1]
    third = np.where(second > 0, numbers[at + 2], 0)
    size = len(hashes)
    if size < 1 << 21:
        keys, counts = np.unique((first * size + second) * size + third, return_counts=True)
        rest, third = np.divmod(keys, size)
        first, second = np.divmod(rest, size)
    else:
        triples, counts = np.unique(np.stack([first, second, third], axis=1), axis=0, return_counts=True)
        first, second, third = triples.T
    h1, h2, h3 = hashes[first], hashes[second], hashes[third]
    salt = np.full(len(h1), -1, np.int32)
    if len(hot):
        own = (second > 0) & np.isin(_mixed(h1, h2), hot)
        salt[own] = (h3[own].view(np.uint64) % np.uint64(SALTS)).astype(np.int32)
    names = [c.split()[0] for c in TRIPLE.split(", ")]
    for a in range(0, len(h1), 50_000):
        columns = (h1, h2, h3, salt, counts.astype(np.int64, copy=False))
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in columns], names=names)


def triples(own: DataFrame, seed: int, hot: np.ndarray) -> DataFrame:
    """Triples of word hashes with partial counts, of texts in columns lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, held, size = LocalWords(seed), [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                held.append(local.numbers(lang.as_py(), text.as_py())[0])
                size += len(held[-1])
                if size >= CHUNK_WORDS:
                    yield from _counted(np.concatenate(held), np.array(local.hashes, np.int64), hot)
                    held, size = [], 0
                    if len(local.hashes) > CHUNK_VOCABULARY:
                        local = LocalWords(seed)
        if held:
            yield from _counted(np.concatenate(held), np.array(local.hashes, np.int64), hot)

    return own.mapInArrow(run, TRIPLE)


def dictionary(own: DataFrame) -> tuple[DataFrame, int]:
    """The distinct words as a stored table h, lang, word, and the seed under which no two share an h."""
    for seed in range(100):
        found = staged(own.mapInArrow(_new_words(seed), "h long, lang string, word string").distinct(), "dictionary")
        if found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return found, seed
    raise RuntimeError("words share hashes under every seed")


def _new_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = LocalWords(seed)
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                rows += [(h, lang, word.decode("utf-8", "surrogatepass")) for h, word in local.numbers(lang, text.as_py())[1]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], names=["h", "lang", "word"])
            if len(local.hashes) > CHUNK_VOCABULARY:
                local = LocalWords(seed)

    return run


def hot_nodes(own: DataFrame, seed: int, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """Mixed hashes of the nodes that have more than ``HOT_SHARE`` of the distinct triples of a sample."""
    part = own.sample(min(1.0, sample / max(own.count(), 1)), seed=11)
    found = triples(part, seed, np.empty(0, np.uint64)).where("h2 <> 0")
    total = found.count()
    # At most 1 / HOT_SHARE nodes can have that share.
    rows = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HOT_LEAST, HOT_SHARE * total)).collect()
    pairs = np.array([(r["h1"], r["h2"]) for r in rows], np.int64).reshape(-1, 2)
    return np.unique(_mixed(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])))


def _flows(least: int):
    """From triples sorted by node: frequent edges, nodes with their flow, and what flows through first words.

    A node's triples may go on in the next batch: its last edge and its flow so far are held back.
    """

    def emitted(h1, h2, h3, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (h1, h2, h3, n)], names=["h1", "h2", "h3", "n"])

    def bounds(*columns: np.ndarray) -> np.ndarray:
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return np.flatnonzero(new)

    def settled(edges: list[np.ndarray], more: int, rest: np.ndarray | None) -> tuple[list[pa.RecordBatch], int]:
        """Of complete edges; ``more`` flowed through the first node before, ``rest`` is an edge that follows."""
        h1, h2, salt, h3, n = edges
        if not len(h1):
            return [], more
        at = bounds(h1, h2, salt)
        flow = np.add.reduceat(n, at)
        flow[0] += more
        own = (h3 != 0) & (n >= least)
        out = [emitted(h1[own], h2[own], h3[own], n[own])]
        n1, n2, ns, left = h1[at], h2[at], salt[at], 0
        if rest is not None and (n1[-1], n2[-1], ns[-1]) == tuple(rest[:3]):
            left, n1, n2, ns, flow = int(flow[-1]), n1[:-1], n2[:-1], ns[:-1], flow[:-1]
        own = (n2 != 0) & ((flow >= least) | (ns >= 0))
        out.append(emitted(n1[own], n2[own], np.zeros(own.sum()), flow[own]))
        if len(n1):
            at = bounds(n1)
            zero = np.zeros(len(at))
            out.append(emitted(n1[at], zero, zero, np.add.reduceat(flow, at)))
        return out, left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, flow = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in ("h1", "h2", "salt", "h3", "n")]
            if held is not None:
                columns = [np.concatenate([[x], c]) for x, c in zip(held, columns)]
            at = bounds(*columns[:4])
            edges = [c[at] for c in columns[:4]] + [np.add.reduceat(columns[4], at)]
            held = [int(c[-1]) for c in edges]
            out, flow = settled([c[:-1] for c in edges], flow, held)
            yield from out
        if held is not None:
            out, _ = settled([np.array([x], np.int64) for x in held], flow, None)
            yield from out

    return run


def counts(own: DataFrame, seed: int, least: int = LEAST) -> DataFrame:
    """h1, h2, h3, n: edges and nodes (h3 0) with ``least`` occurrences or more, all words (h2 0 too)."""
    dealt = triples(own, seed, hot_nodes(own, seed)).repartition("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "h3")
    flows = dealt.mapInArrow(_flows(least), "h1 long, h2 long, h3 long, n long")
    total = flows.groupBy("h1", "h2", "h3").agg(F.sum("n").alias("n"))
    return total.where((F.col("h2") == 0) | (F.col("n") >= least))


# --- compaction ---------------------------------------------------------------------------------


def compact(edges: DataFrame) -> DataFrame:
    """Paths over unary nodes: h1, h2, tail (the following words), n (the weight) and flow (the first node's).

    ``edges`` is a stored table h1, h2, h3, n, flow, where flow is that of the edge's first node. Every
    edge is in one path. A path lies within a piece of text, as no piece ends at a unary node, so it is
    no longer than one.
    """
    # The only out-edge of a node, after the only in-edge of it: both weigh as much as the node.
    sole = edges.where("n = flow").select("h1", "h2", "h3", "n")
    into = edges.select(F.col("h1").alias("a1"), F.col("h2").alias("h1"), F.col("h3").alias("h2"), "n")
    links = sole.join(into, ["h1", "h2", "n"]).select("h1", "h2", "h3", F.col("a1"), F.col("h1").alias("a2"), F.col("h2").alias("a3"), F.lit(1).cast("long").alias("steps"))
    links = staged(links, "path-links")
    seen = _steps(links)
    for _ in range(MAX_ROUNDS):
        onward = links.select(
            F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("h3").alias("a3"),
            F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("a3").alias("b3"), F.col("steps").alias("more"),
        )
        joined = links.join(onward, ["a1", "a2", "a3"], "left").select(
            "h1", "h2", "h3", *(F.coalesce(f"b{i}", f"a{i}").alias(f"a{i}") for i in (1, 2, 3)),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
        )
        links = staged(joined, "path-links")
        now = _steps(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("paths did not settle")
    placed = edges.join(links, ["h1", "h2", "h3"], "left")
    head = [F.coalesce(f"a{i}", f"h{i}").alias(f"a{i}") for i in (1, 2, 3)]
    placed = placed.select(*head, F.coalesce("steps", F.lit(0)).alias("steps"), "h3", "n", "flow")
    return (
        placed.groupBy("a1", "a2", "a3")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("steps", "h3"))), lambda x: x["h3"]).alias("tail"),
            F.max("n").alias("n"), F.max(F.when(F.col("steps") == 0, F.col("flow"))).alias("flow"),
        )
        .select(F.col("a1").alias("h1"), F.col("a2").alias("h2"), "tail", "n", "flow")
    )


def _steps(links: DataFrame) -> int:
    return links.agg(F.coalesce(F.sum("steps"), F.lit(0))).first()[0]


# --- candidates ---------------------------------------------------------------------------------


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("l", "r", "score")]))
def _lowest_cut(a: pd.Series, l1: pd.Series, r1: pd.Series, l2: pd.Series, r2: pd.Series) -> pd.DataFrame:
    """The cut with the lowest score, the first of equal ones; a cut without r does not exist."""
    rows = []
    for n, *sides in zip(a.tolist(), l1.tolist(), r1.tolist(), l2.tolist(), r2.tolist()):
        cuts = [(1_000_000 * n * n // (l * r), k, l, r) for k, (l, r) in enumerate((sides[:2], sides[2:])) if r]  # noqa: E741
        score, _, l, r = min(cuts)  # noqa: E741
        rows.append((l, r, score))
    return pd.DataFrame(rows, columns=["l", "r", "score"])


def graph(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored tables of a corpus: word counts (h, lang, word, n), nodes (h1, h2, flow) and compacted paths.

    Words are counted per language, a NULL one is ``und``; NULL texts are empty. Nodes and paths are
    those of at least ``least`` occurrences.
    """
    text_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), blank(text).alias("text"))
    known, seed = dictionary(own)
    found = staged(counts(own, seed, least), "phrase-counts")
    word_counts = staged(found.where("h2 = 0").select(F.col("h1").alias("h"), "n").join(known, "h"), "word-counts")
    nodes = found.where("h2 <> 0 and h3 = 0").select("h1", "h2", F.col("n").alias("flow"))
    edges = staged(found.where("h3 <> 0").join(nodes, ["h1", "h2"]).select("h1", "h2", "h3", "n", "flow"), "graph-edges")
    return word_counts, nodes, staged(compact(edges), "graph-paths")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two and three words of every language.

    Candidates occur ``least`` times or more (a); l and r are the counts of the two sides of the cut with
    the lowest score, n the words of the language. A pair inside a triple that has ``cover`` per cent of
    its occurrences is dropped. Ties in score and a go to the phrase that comes first in byte order.
    Repeated rows count each; other columns are ignored; no words, no rows.
    """
    word_counts, nodes, paths = graph(docs, lang, text, least)
    last = paths.select("*", F.concat(F.array("h1", "h2"), "tail").alias("walk"))
    end = nodes.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("flow").alias("end_flow"))
    ended = last.join(end, (F.element_at("walk", -2) == F.col("e1")) & (F.element_at("walk", -1) == F.col("e2")))
    ended = staged(ended.select("walk", "n", "flow", "end_flow"), "ended-paths")

    word = lambda i: F.element_at("walk", F.col("at") + i)
    edges = ended.select("*", F.explode(F.sequence(F.lit(1), F.size("walk") - 2)).alias("at"))
    triple = edges.select(
        *(word(i).alias(f"h{i + 1}") for i in range(3)), F.col("n").alias("a"),
        F.when(F.col("at") == 1, F.col("flow")).otherwise(F.col("n")).alias("f12"),
        F.when(F.col("at") == F.size("walk") - 2, F.col("end_flow")).otherwise(F.col("n")).alias("f23"),
    )
    pairs = ended.select("walk", "n", F.explode(F.sequence(F.lit(1), F.size("walk") - 1)).alias("at"))
    covered = pairs.groupBy(word(0).alias("h1"), word(1).alias("h2")).agg(F.max("n").alias("most"))
    pair = nodes.join(covered, ["h1", "h2"], "left").where(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("flow")))
    none = F.lit(None).cast("long")
    pair = pair.select("h1", "h2", none.alias("h3"), F.col("flow").alias("a"), none.alias("f12"), none.alias("f23"))

    found = triple.unionByName(pair)
    common = word_counts.where(F.col("n") >= least)
    for i in (1, 2, 3):
        side = common.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("n").alias(f"n{i}"), *([F.col("lang").alias("lang")] if i == 1 else []))
        found = found.join(side, f"h{i}", "left" if i == 3 else "inner")
    zero = F.lit(0).cast("long")
    is_pair = F.col("h3").isNull()
    best = _lowest_cut("a", "n1", F.when(is_pair, F.col("n2")).otherwise(F.col("f23")), F.coalesce("f12", zero), F.coalesce("n3", zero))
    scored = found.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", best.alias("best")).select("lang", "phrase", "a", "best.*")
    ranked = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # First within parts of a language, so that a language of most rows is not sorted in one task.
    for keys in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    totals = word_counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) + 2 - k)) AS i FROM worded, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
), counts AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
), candidates AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND a >= {LEAST}
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, l.a AS l, r.a AS r, CAST((1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 : c.k], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), covers AS (
  SELECT lang, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase, a FROM candidates WHERE k = 3
), most AS (
  SELECT lang, phrase, max(a) AS a FROM covers GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, t.n, b.score
  FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN most m ON b.k = 2 AND m.lang = b.lang AND m.phrase = b.phrase
  WHERE m.a IS NULL OR 100 * m.a < {COVER} * b.a
)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
