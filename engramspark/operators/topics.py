"""Who names the topics: aliases found by similarity, or by a model asked store by store."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MemoryConfig
from ..session import materialize, ship_package
from .components import connected_components
from .groups import map_groups
from .similarity import knn_join

TOPICS_PER_CALL = 500


def topic_uses(passages: DataFrame) -> DataFrame:
    """``(store_id, topic, uses)`` of all topics in lower case; empty ones have no name to merge."""
    topics = passages.select("store_id", F.explode("topics").alias("t")).select("store_id", F.lower("t").alias("topic"))
    return topics.where("topic <> ''").groupBy("store_id", "topic").agg(F.count(F.lit(1)).alias("uses"))


def similar_aliases(passages: DataFrame, embedder, threshold: float = 0.75, config: MemoryConfig = DEFAULT) -> DataFrame:
    """``(store_id, alias, canonical)``: topics that a chain of similar names links share the name of the most used one.

    Of equally used names the shorter is elected, then the first by alphabet. Feeds ``tags.consolidate_topics``.
    """
    ship_package(passages.sparkSession)
    uses = materialize(topic_uses(passages))
    named = uses.select("store_id", "topic", embedder.column(F.col("topic")).alias("vec"))
    # any order that is unique in a store will do for a join without a cap
    items = materialize(named.select("store_id", F.col("topic").alias("item_id"), F.xxhash64("topic").alias("seq"), "vec"))
    pairs = knn_join(items, ["store_id"], threshold, None, config).where("query_id < item_id")
    groups = materialize(connected_components(pairs.select("store_id", F.col("query_id").alias("a"), F.col("item_id").alias("b")), ["store_id"]))
    ranked = groups.join(uses, (groups["store_id"] == uses["store_id"]) & (groups["node"] == uses["topic"])).select(groups["store_id"], "root", "topic", "uses")
    elected = ranked.groupBy("store_id", "root").agg(F.min_by("topic", F.struct(-F.col("uses"), F.length("topic"), "topic")).alias("canonical"))
    return ranked.join(elected, ["store_id", "root"]).where("topic <> canonical").select("store_id", F.col("topic").alias("alias"), "canonical")


def asked_merges(passages: DataFrame, call: Callable[[list[str]], list[dict]], per_call: int = TOPICS_PER_CALL) -> DataFrame:
    """Merge groups ``(store_id, ord, canonical, aliases)`` as a model gives them for a store's topics, for ``tags.alias_table``.

    A store with more topics than ``per_call`` is asked in blocks of neighbours by name, so no prompt and no task grows with it.
    A failed call gives no groups. Results are written once, so that no call is repeated.
    """
    uses = topic_uses(passages)
    sizes = uses.groupBy("store_id").agg(F.ceil(F.count(F.lit(1)) / per_call).alias("blocks"))
    # names with one beginning stay together
    block = F.pmod(F.xxhash64(F.substring("topic", 1, 3)), F.col("blocks")).alias("block")
    blocks = uses.join(sizes, "store_id").select("store_id", "topic", block)

    def ask(t: pa.Table) -> dict:
        topics, found = t["topic"].to_pylist(), []
        for at in range(0, len(topics), per_call):
            try:
                found += [(g["canonical"], list(g["aliases"])) for g in call(topics[at : at + per_call]) if g.get("aliases")]
            except Exception:
                continue
        return {
            "store_id": pa.array([t["store_id"][0].as_py()] * len(found), t["store_id"].type), "ord": [t["block"][0].as_py() * 1_000_000 + i for i in range(len(found))],
            "canonical": [c for c, _ in found], "aliases": [a for _, a in found],
        }

    kind = passages.schema["store_id"].dataType.simpleString()
    return materialize(map_groups(blocks, ["store_id", "block"], ["topic"], ask, f"store_id {kind}, ord bigint, canonical string, aliases array<string>"))
