"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shiftlab.llm import bpe, collocations, decontam, imatch, language, lines, packing, pii, prefix_trie, quality, secrets, sharding, simhash
from shiftlab.llm.common import read_table

# Conversations are rebuilt in blocks of so many ids.
BLOCK = 20

# Queries without SQL here are tested against brute force, round trips or held-out accuracy.
ORACLES: dict[str, str] = {
    "op1_sharding": sharding.ORACLE,
    "op7_line_dedup": lines.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_prefix_trie": prefix_trie.oracle(BLOCK),
}


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document, by the hash of its id, at most 1 MiB of text each."""
    return sharding.shard_documents(read_table(spark, folder, "documents"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fold."""
    return quality.predict(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned outside the held-out fold."""
    return language.predict(read_table(spark, folder, "documents"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, judged by how many owners hold them in the corpus."""
    return secrets.scan(read_table(spark, folder, "documents"))


def op6_imatch(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return imatch.edited_documents(read_table(spark, folder, "documents"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every dropped line of the documents with the earlier line that is kept."""
    return lines.duplicate_lines(read_table(spark, folder, "documents")).drop("row")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces in training sequences of up to 2048 tokens."""
    return packing.pack_documents(read_table(spark, folder, "documents"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms of the same format."""
    return pii.pseudonymise(read_table(spark, folder, "documents"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of a benchmark item in the documents."""
    return decontam.contaminations(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The leading collocations of every language."""
    return collocations.collocations(read_table(spark, folder, "documents"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(read_table(spark, folder, "conversations"), BLOCK)


def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level BPE tokens of every document, and their decoding."""
    return bpe.encode_documents(read_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_secrets": op5_secrets,
    "op6_imatch": op6_imatch,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_pii": op9_pii,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_bpe": op13_bpe,
}
