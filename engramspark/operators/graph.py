"""The entity-passage graph as node and edge tables.

An edge table holds both directions: ``(store_id, src, dst, w)``. Node names are
``entity:<name>`` and ``passage:<seq>``.
"""

from __future__ import annotations

from bisect import insort

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MemoryConfig
from ..functions.text import significant_name
from .groups import map_groups, ordinals
from .similarity import knn_join


def entity_node(c: Column) -> Column:
    return F.concat(F.lit("entity:"), c)


def passage_node(c: Column) -> Column:
    return F.concat(F.lit("passage:"), c.cast("string"))


def both_ways(df: DataFrame, a: str, b: str, *rest: str) -> DataFrame:
    """Each row in both directions from one scan."""
    ends = F.explode(
        F.array(
            F.struct(F.col(a).alias("src"), F.col(b).alias("dst")),
            F.struct(F.col(b).alias("src"), F.col(a).alias("dst")),
        )
    )
    return df.select("store_id", ends.alias("_e"), *rest).select("store_id", "_e.src", "_e.dst", *rest)


def fact_edges(triples: DataFrame) -> DataFrame:
    """Weight 1 per triple occurrence and direction; a self-loop collects 2 per triple.

    Unordered pairs are counted, so that one row per pair is shuffled and turned both ways afterwards.
    """
    pair = F.sort_array(F.array(entity_node(F.col("subject")), entity_node(F.col("object"))))
    n = F.count(F.lit(1)).cast("double")
    pairs = triples.select("store_id", pair.alias("_p")).select("store_id", F.col("_p")[0].alias("a"), F.col("_p")[1].alias("b"))
    way = lambda a, b, w: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), w.alias("w"))
    ways = F.when(F.col("a").eqNullSafe(F.col("b")), F.array(way("a", "b", F.col("_n") * 2))).otherwise(
        F.array(way("a", "b", F.col("_n")), way("b", "a", F.col("_n")))
    )
    return pairs.groupBy("store_id", "a", "b").agg(n.alias("_n")).select("store_id", F.explode(ways).alias("_e")).select(
        "store_id", "_e.src", "_e.dst", "_e.w"
    )


def passage_edges(mentions: DataFrame) -> DataFrame:
    """Weight 1 between a passage and each entity it mentions."""
    ends = mentions.select(
        "store_id", passage_node(F.col("passage_seq")).alias("p"), entity_node(F.col("entity")).alias("e")
    )
    return both_ways(ends, "p", "e").withColumn("w", F.lit(1.0))


def graph_nodes(entities: DataFrame, passages: DataFrame) -> DataFrame:
    return entities.select(
        "store_id", entity_node(F.col("entity")).alias("node"), F.lit("entity").alias("type")
    ).unionByName(
        passages.select(
            "store_id", passage_node(F.col("passage_seq")).alias("node"), F.lit("passage").alias("type")
        )
    )


def out_weights(edges: DataFrame) -> DataFrame:
    return edges.groupBy("store_id", "src").agg(F.sum("w").alias("out_weight"))


def edge_weight(edges: DataFrame, store_id, src: str, dst: str) -> Column:
    """Filter form of a weight lookup, 0 when the edge is missing."""
    hit = edges.where((F.col("store_id") == store_id) & (F.col("src") == src) & (F.col("dst") == dst))
    return hit.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node).select("store_id", "dst", "w")


def nodes_of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("type") == kind)


def remove_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges left once ``gone(store_id, node)`` and everything incident is dropped."""
    g = gone.select("store_id", "node").distinct()
    left = edges.join(g.withColumnRenamed("node", "src"), ["store_id", "src"], "left_anti")
    return left.join(g.withColumnRenamed("node", "dst"), ["store_id", "dst"], "left_anti").select(
        *edges.columns
    )


def synonym_pairs(entities: DataFrame, config: MemoryConfig = DEFAULT) -> DataFrame:
    """Similar entities at the present time: ``(store_id, a, b, score, rank)``.

    A short name never looks for neighbours but may be found as one, and the cap on
    neighbours counts per searching side only.
    """
    items = entities.select(
        "store_id", F.col("entity").alias("item_id"), F.col("entity_seq").alias("seq"), "vec"
    )
    found = knn_join(items, ["store_id"], config.synonymy_threshold, config.synonymy_top_k, config)
    return found.where(significant_name(F.col("query_id"))).select(
        "store_id", F.col("query_id").alias("a"), F.col("item_id").alias("b"), "score", "rank"
    )


def synonym_writes(entities: DataFrame, config: MemoryConfig = DEFAULT) -> DataFrame:
    """When each similarity edge was last written: ``(store_id, a, b, score, set_at)``.

    Similarity edges are rewritten at every passage that introduces an entity, for the best
    neighbours of that time, and are never withdrawn. Neighbour b leaves a's best ``k`` for
    good when the k-th better neighbour is born, so its last write is the introducing
    passage before that birth, or the newest one when it never left.
    """
    k = config.synonymy_top_k
    items = entities.select(
        "store_id", F.col("entity").alias("item_id"), F.col("entity_seq").alias("seq"), "vec",
        F.col("first_passage_seq").cast("bigint").alias("born"),
    )
    found = knn_join(items, ["store_id"], config.synonymy_threshold, k, config, over_time=True)
    found = found.where(significant_name(F.col("query_id")))

    def leave_times(t: pa.Table) -> dict:
        births: list[int] = []
        out = []
        for born in t["born"].to_pylist():
            out.append(births[k - 1] if len(births) >= k else None)
            insort(births, born)
            del births[k:]
        same = {c: t[c].combine_chunks() for c in ("store_id", "query_id", "item_id", "score")}
        together = pc.max_element_wise(t["query_born"], t["born"])
        return same | {"together": together.combine_chunks(), "left_at": out}

    store = found.schema["store_id"].dataType.simpleString()
    spans = map_groups(
        found, ["store_id", "query_id"], [F.desc("score"), F.col("seq")], leave_times,
        f"store_id {store}, query_id string, item_id string, score double, together bigint, left_at bigint",
    ).where(F.col("left_at").isNull() | (F.col("left_at") > F.col("together")))
    intros = entities.select("store_id", F.col("first_passage_seq").cast("bigint").alias("t")).distinct()
    numbered = ordinals(intros, ["store_id"], ["t"], "n")
    before = numbered.select("store_id", F.col("t").alias("left_at"), (F.col("n") - 1).alias("n")).join(
        numbered.select("store_id", "n", F.col("t").alias("prev")), ["store_id", "n"]
    ).drop("n")
    newest = intros.groupBy("store_id").agg(F.max("t").alias("newest"))
    return (
        spans.join(before, ["store_id", "left_at"], "left").join(newest, "store_id")
        .select("store_id", F.col("query_id").alias("a"), F.col("item_id").alias("b"), "score",
                F.when(F.col("left_at").isNull(), F.col("newest")).otherwise(F.col("prev")).alias("set_at"))
    )


def ledger_edges(triples: DataFrame, writes: DataFrame) -> DataFrame:
    """Entity edges after all writes: a similarity edge overwrites, later triples add on top.

    A similar pair weighs its score plus its triples from passages after the pair's last
    write (from either side); any other pair weighs all its triples.
    """
    key = ["store_id", "src", "dst"]
    ends = triples.select(
        "store_id", entity_node(F.col("subject")).alias("s"), entity_node(F.col("object")).alias("o"),
        F.col("passage_seq").cast("bigint").alias("passage_seq"),
    )
    adds = fact_edges(triples).withColumnRenamed("w", "_all")
    sets = both_ways(
        writes.select("store_id", entity_node(F.col("a")).alias("s"), entity_node(F.col("b")).alias("o"), "score", "set_at"),
        "s", "o", "score", "set_at",
    ).groupBy(*key).agg(F.max("score").alias("_set"), F.max("set_at").alias("_at"))
    late = (
        both_ways(ends, "s", "o", "passage_seq").join(sets, key)
        .where(F.col("passage_seq") > F.col("_at"))
        .groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("_late"))
    )
    w = F.when(F.col("_set").isNotNull(), F.col("_set") + F.coalesce("_late", F.lit(0.0)))
    return adds.join(sets, key, "full").join(late, key, "left").select(
        *key, w.otherwise(F.col("_all")).alias("w")
    )
