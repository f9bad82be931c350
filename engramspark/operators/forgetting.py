"""Pruning of old, unimportant passages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MemoryConfig
from ..functions.text import triple_text
from ..session import lookup, materialize
from .graph import entity_node, fact_edges, passage_edges, passage_node, remove_nodes
from .groups import top_rows
from .ingest import build_entities, build_facts, build_mentions

HOUR_MS = 3_600_000.0


def forget_score(
    salience: Column, stored_ms: Column, access_count: Column, last_access_ms: Column, as_of_ms
) -> Column:
    """Higher is more forgettable: unimportant and old, less what a recent access gives back."""
    now = F.lit(as_of_ms).cast("double")
    age = (now - stored_ms) / HOUR_MS
    recency = F.when(
        access_count > 0, F.lit(1.0) / (F.lit(1.0) + (now - last_access_ms) / HOUR_MS)
    ).otherwise(F.lit(0.0))
    return (F.lit(1.0) - salience) * F.log(F.lit(1.0) + age) - recency


def score_passages(passages: DataFrame, as_of_ms) -> DataFrame:
    return passages.withColumn(
        "forget_score",
        forget_score(
            F.col("salience"), F.col("timestamp_ms"), F.col("access_count"), F.col("last_accessed_ms"),
            as_of_ms,
        ),
    )


def kept_passages(passages: DataFrame, as_of_ms, config: MemoryConfig = DEFAULT) -> DataFrame:
    """``(store_id, passage_seq)`` of the ``max_passages`` lowest scores of each store. Equal scores: the later one stays."""
    scored = score_passages(passages, as_of_ms)
    return top_rows(
        scored, ["store_id"], [F.col("forget_score"), F.desc("passage_seq")], config.max_passages
    ).select("store_id", "passage_seq")


def forget_candidates(passages: DataFrame, as_of_ms, config: MemoryConfig = DEFAULT) -> DataFrame:
    """Passages beyond the store's capacity, most forgettable first.

    Expressed through the ones that stay, which is a bounded top-k per store; everything else goes.
    """
    return score_passages(passages, as_of_ms).join(kept_passages(passages, as_of_ms, config), ["store_id", "passage_seq"], "left_anti")


class Pruned(NamedTuple):
    passages: DataFrame
    triples: DataFrame
    mentions: DataFrame
    entities: DataFrame
    facts: DataFrame
    edges: DataFrame


def remove_passages(
    gone: DataFrame, passages: DataFrame, triples: DataFrame, mentions: DataFrame,
    entities: DataFrame, facts: DataFrame, edges: DataFrame,
) -> Pruned:
    """Drop ``gone(store_id, passage_seq)`` with what only it supported.

    Entities left without a passage and facts no remaining passage states are dropped;
    weights of surviving edges and owners of surviving facts stay as they were.
    """
    key = ["store_id", "passage_seq"]
    dead = gone.select(*key).distinct()
    flagged = lambda df: df.join(dead.withColumn("_dead", F.lit(True)), key, "left")
    unsupported = lambda df, name: df.groupBy("store_id", name).agg(F.count_if(F.col("_dead").isNull()).alias("_alive")).where("_alive = 0").drop("_alive")
    seen, stated = flagged(mentions), flagged(triples)
    orphans = unsupported(seen, "entity")
    lost = unsupported(stated.withColumn("fact", triple_text(F.col("subject"), F.col("predicate"), F.col("object"))), "fact")
    left_mentions, left_triples = (df.where(F.col("_dead").isNull()).select(*names) for df, names in ((seen, mentions.columns), (stated, triples.columns)))
    nodes = dead.select("store_id", passage_node(F.col("passage_seq")).alias("node")).unionByName(
        orphans.select("store_id", entity_node(F.col("entity")).alias("node"))
    )
    return Pruned(
        passages.join(dead, key, "left_anti"),
        left_triples,
        left_mentions,
        entities.join(orphans, ["store_id", "entity"], "left_anti"),
        facts.join(lost, ["store_id", "fact"], "left_anti"),
        remove_nodes(edges, nodes),
    )


def keep_passages(kept: DataFrame, passages: DataFrame, triples: DataFrame) -> Pruned:
    """What ``remove_passages`` leaves of a memory whose tables all follow from ``triples``, told by ``kept(store_id, passage_seq)``.

    What stays is bounded by capacity and so, once counted, broadcast: ``triples`` are filtered where they are read, and only those
    between entities that stay are counted into edges.
    """
    key = ["store_id", "passage_seq"]
    stay = lookup(kept.select(*key).distinct())
    stated = materialize(triples.join(stay, key, "left_semi").select(*triples.columns))
    mentions = build_mentions(stated)
    alive = lookup(mentions.select("store_id", "entity").distinct())
    facts = lookup(stated.select("store_id", triple_text(F.col("subject"), F.col("predicate"), F.col("object")).alias("fact")).distinct())
    between = triples
    for side in ("subject", "object"):
        between = between.join(alive.select("store_id", F.col("entity").alias(side)), ["store_id", side], "left_semi")
    return Pruned(
        passages.join(stay, key, "left_semi"),
        stated,
        mentions,
        build_entities(triples).join(alive, ["store_id", "entity"], "left_semi"),
        build_facts(triples).join(facts, ["store_id", "fact"], "left_semi"),
        fact_edges(between).unionByName(passage_edges(mentions)),
    )


def apply_access_log(passages: DataFrame, log: DataFrame) -> DataFrame:
    """Fold returned-passage events ``(store_id, passage_seq, at_ms)`` into the counters."""
    seen = log.groupBy("store_id", "passage_seq").agg(
        F.count(F.lit(1)).alias("_n"), F.max("at_ms").alias("_at")
    )
    rest = [c for c in passages.columns if c not in ("access_count", "last_accessed_ms")]
    return passages.join(seen, ["store_id", "passage_seq"], "left").select(
        *rest,
        (F.col("access_count") + F.coalesce("_n", F.lit(0))).alias("access_count"),
        F.greatest("last_accessed_ms", F.coalesce("_at", F.lit(0))).cast("bigint").alias("last_accessed_ms"),
    )
