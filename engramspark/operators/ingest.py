"""Triples to entity, fact and mention tables.

All tables carry ``store_id``. Rows are keyed by their natural text; the 32-bit ids are
columns, so a hash collision never merges two memories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_id, triple_text

#: Bits of a triple's place in its passage. An array of triples of three strings takes 64 bytes each and Spark's rows end at 2 GB, so
#: no array has more than 2^25; passages of a store may number up to 2^37.
ORD_BITS = 25


def occurrence_seq(passage_seq: str = "passage_seq", ordinal: str = "ord"):
    """One number ordering triple occurrences by passage, then by position in it."""
    return F.shiftleft(F.col(passage_seq).cast("bigint"), ORD_BITS) + F.col(ordinal).cast("bigint")


def explode_triples(passages: DataFrame) -> DataFrame:
    """``passages(store_id, passage_seq, triples)`` to one row per triple."""
    return passages.select(
        "store_id", "passage_seq", F.posexplode("triples").alias("ord", "t")
    ).select("store_id", "passage_seq", "ord", "t.subject", "t.predicate", "t.object")


def build_facts(triples: DataFrame) -> DataFrame:
    """One row per fact text; the first occurrence owns it and supplies its split.

    ``min_by`` aggregates before the shuffle, so a fact repeated in a third of all
    passages reaches the reducers as one partial row per task.
    """
    fact = triple_text(F.col("subject"), F.col("predicate"), F.col("object"))
    first = F.min_by(
        F.struct("subject", "predicate", "object", F.col("passage_seq").cast("bigint").alias("owner_seq")),
        F.col("_seq"),
    )
    return (
        triples.withColumn("fact", fact)
        .withColumn("_seq", occurrence_seq())
        .groupBy("store_id", "fact")
        .agg(first.alias("_f"), F.min("_seq").alias("fact_seq"))
        .select(
            "store_id", "fact", hash_id(F.col("fact"), "fact-").alias("fact_id"),
            "_f.subject", "_f.predicate", "_f.object", "_f.owner_seq", "fact_seq",
        )
    )


def entity_occurrences(triples: DataFrame, *more: str) -> DataFrame:
    """Subject then object of every triple, in order, with further columns of the triple."""
    seq = F.shiftleft(occurrence_seq(), 1)
    sides = F.array(
        F.struct(F.col("subject").alias("entity"), seq.alias("seq")),
        F.struct(F.col("object").alias("entity"), (seq + 1).alias("seq")),
    )
    return triples.select(
        "store_id", F.col("passage_seq").cast("bigint").alias("passage_seq"),
        F.explode(sides).alias("e"), *more,
    ).select("store_id", "passage_seq", "e.entity", "e.seq", *more)


def build_entities(triples: DataFrame) -> DataFrame:
    """Distinct entities with their first position and first passage."""
    return (
        entity_occurrences(triples)
        .groupBy("store_id", "entity")
        .agg(F.min("seq").alias("entity_seq"), F.min("passage_seq").alias("first_passage_seq"))
        .withColumn("entity_id", hash_id(F.col("entity"), "entity-"))
    )


def build_mentions(triples: DataFrame) -> DataFrame:
    """Distinct (entity, passage)."""
    return entity_occurrences(triples).select("store_id", "entity", "passage_seq").distinct()


def mention_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("store_id", "entity").agg(F.count(F.lit(1)).alias("passages"))


def only_new(candidates: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Candidates not stored yet; the earliest of equal ones in the batch is kept.

    ``candidates(store_id, key, seq, ...)``.
    """
    rest = [c for c in candidates.columns if c not in ("store_id", key)]
    once = candidates.groupBy("store_id", key).agg(F.min_by(F.struct(*rest), F.col("seq")).alias("_r"))
    return once.join(stored.select("store_id", key).distinct(), ["store_id", key], "left_anti").select("store_id", key, "_r.*")


def id_collisions(df: DataFrame, keys: list[str], text: str, prefix: str) -> DataFrame:
    """Ids shared by more than one text."""
    return (
        df.select(*keys, text).distinct()
        .withColumn("hash_id", hash_id(F.col(text), prefix))
        .groupBy(*keys, "hash_id")
        .agg(F.count(F.lit(1)).alias("texts"))
        .where(F.col("texts") > 1)
    )


def store_stats(
    passages: DataFrame, entities: DataFrame, facts: DataFrame, nodes: DataFrame
) -> DataFrame:
    """Counts of passages, entities, facts and graph nodes per store."""
    parts = [("passages", passages), ("entities", entities), ("facts", facts), ("graph_nodes", nodes)]
    kinds = None
    for name, df in parts:
        one = df.groupBy("store_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(name))
        kinds = one if kinds is None else kinds.unionByName(one)
    return kinds.groupBy("store_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k, _ in parts]
    )
