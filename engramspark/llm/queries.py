"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramspark.llm import block_search, byte_conv, context_tree, line_quality, mixing, noisy_channel, pattern_packing, pii_boosting, role_repair, run_length_index, superminhash, token_counts, winnowing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by heap-and-linked-list merging under byte_bpe_50k.json."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated sampling rate and decision of every document."""
    rows = mixing.sampled(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), *mixing.MARGINS, "tokens", "rate", "kept")


def id_remainder(n: int, doc_id: Column | None = None) -> Column:
    """crc32 of the document id as text, modulo ``n``: the folds of the learning queries."""
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % n


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree weighting and word-count scores of every whole text."""
    return context_tree.score(table(spark, sf_dir, "documents"), held_out=id_remainder(10) == 0)


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts packed into sequences of 1024 tokens by fitted length patterns."""
    return pattern_packing.pack(table(spark, sf_dir, "documents"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every whole text, of its edited form and of its neighbour."""
    return winnowing.compare_neighbours(table(spark, sf_dir, "documents"))


def op6_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text after noisy-channel deobfuscation."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return noisy_channel.toxicity(docs, labels, held_out=lambda i: id_remainder(5, i) == 0)


def op7_byte_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text by a byte convolutional network."""
    return byte_conv.identify(table(spark, sf_dir, "documents"), held_out=id_remainder(4) == 2)


def op8_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by a 400-byte string that also starts elsewhere, removed."""
    return run_length_index.long_repeats(table(spark, sf_dir, "documents"), length=400)


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over 4-word shingles at a similarity of 0.8."""
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and line-first verdict of every whole text."""
    return line_quality.verdicts(table(spark, sf_dir, "documents"))


def op11_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item by blocked posting lists."""
    return block_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: strict patterns and boosted candidates."""
    return pii_boosting.find(table(spark, sf_dir, "documents"))


def op13_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged conversation repaired to the role grammar by weighted edits."""
    return role_repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_raking": op2_raking,
    "op3_context_tree": op3_context_tree,
    "op4_pattern_packing": op4_pattern_packing,
    "op5_winnowing": op5_winnowing,
    "op6_noisy_channel": op6_noisy_channel,
    "op7_byte_conv": op7_byte_conv,
    "op8_run_length_index": op8_run_length_index,
    "op9_superminhash": op9_superminhash,
    "op10_line_quality": op10_line_quality,
    "op11_block_search": op11_block_search,
    "op12_pii_boosting": op12_pii_boosting,
    "op13_role_repair": op13_role_repair,
}
