"""From raw documents to packed training sequences: each stage calls one operator of ``engramspark.llm``.

Documents that fail the line rules go, one document of each group of near duplicates stays, passages that also stand
elsewhere are cut out, the rest is sampled to the target mixture, and what remains is packed. Every stage works on all rows the
one before has kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engramspark.llm import line_quality, mixing, pattern_packing, run_length_index, superminhash
from engramspark.session import ensure_checkpoint_dir

#: A passage of more than 50 words has at least this many bytes, but for one in a hundred of those in the given texts.
REPEAT_BYTES = 230


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first quality rules: failing lines and rejected documents go."""
    return line_quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SuperMinHash over five-word shingles at 0.8: the first document of each component stays."""
    return superminhash.drop_near_duplicates(docs, k=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Run-length index: bytes covered by a string of REPEAT_BYTES that also starts elsewhere go."""
    return run_length_index.remove_repeats(docs, length=REPEAT_BYTES, gram=32)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Iterative proportional fitting: a sample with the target weights of source, language and topic stays."""
    return mixing.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pattern packing into sequences of 1024 tokens, one row per piece."""
    return pattern_packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("near duplicates", near_duplicates), ("suffix repeats", repeats), ("source mixture", mixture), ("packing", packing),
]

#: Verification on shingle sets, repeats of arbitrary bytes and byte-pair merging have no SQL form; tests/llm has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
