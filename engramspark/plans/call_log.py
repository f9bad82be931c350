"""Recognize and recall calls of all stores as one table of operations instead of one agent after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, MemoryConfig
from ..operators.groups import ordinals
from ..session import materialize
from ..sources.providers import Embedder, TripleFilter
from .index import Memory
from .retrieve import embed_queries, recall, recognize


def seed_sources(log: DataFrame, block: int = 100_000) -> DataFrame:
    """``log(store_id, op_no, kind, ...)`` with ``source_op``: from where an operation has its seeds.

    A recognize has its own; a recall has those of the newest recognize before it in its store, or none. ``op_no`` is unique in a
    store. A store is cut into blocks of its operations, so a busy one is spread over many tasks.
    """
    placed = ordinals(log, ["store_id"], ["op_no"], "_n").withColumn("_block", F.floor(F.col("_n") / block))
    mine = F.when(F.col("kind") == "recognize", F.col("op_no"))
    newest = placed.groupBy("store_id", "_block").agg(F.max(mine).alias("_newest"))
    earlier = Window.partitionBy("store_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    newest = newest.select("store_id", "_block", F.max("_newest").over(earlier).alias("_before"))
    inside = Window.partitionBy("store_id", "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("_own", F.max(mine).over(inside)).join(newest, ["store_id", "_block"]).select(
        *log.columns, F.coalesce("_own", "_before").alias("source_op")
    )


def carried_triples(sources: DataFrame, recognized: DataFrame) -> DataFrame:
    """Seeds of every recall: ``(store_id, op_no, source_op, pos, subject, predicate, object)``.

    ``sources`` from ``seed_sources``; ``recognized(store_id, op_no, pos, subject, predicate, object)`` of the recognize operations. A
    recognize that found nothing is a source like any other: the recalls after it have no seeds and no rows, not those of an
    earlier one.
    """
    found = recognized.withColumnRenamed("op_no", "source_op")
    return sources.where("kind = 'recall'").select("store_id", "op_no", "source_op").join(found, ["store_id", "source_op"]).select(
        "store_id", "op_no", "source_op", "pos", "subject", "predicate", "object"
    )


def answer_log(
    memory: Memory, log: DataFrame, embedder: Embedder, triple_filter: TripleFilter | None = None, config: MemoryConfig = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """(triples of every recognize, passages of every recall) of ``log(store_id, op_no, kind, query_text)``, keyed by ``op_no``."""
    log = materialize(log)
    asked = embed_queries(log.select("store_id", F.col("op_no").alias("query_id"), "kind", "query_text"), embedder)
    recognized = materialize(recognize(memory, asked.where("kind = 'recognize'"), triple_filter, config))
    seeds = carried_triples(seed_sources(log), recognized.withColumnRenamed("query_id", "op_no")).drop("source_op")
    found = recall(memory, asked.where("kind = 'recall'"), seeds.withColumnRenamed("op_no", "query_id"), config)
    return recognized.withColumnRenamed("query_id", "op_no"), found.withColumnRenamed("query_id", "op_no")
