"""Write path: exchanges to the tables of a memory."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MemoryConfig
from ..functions.text import passage_key, utf16_left
from ..operators import forgetting, graph, ingest, lifetimes
from ..operators.groups import ordinals
from ..session import discard, materialize, settled, ship_package, spread
from ..sources.providers import Embedder, Extractor


@dataclass(frozen=True)
class Memory:
    """Tables of many stores, each row carrying its ``store_id``.

    passages(passage_seq, passage_id, text, types, topics, salience, timestamp_ms,
    access_count, last_accessed_ms, vec); triples; facts and entities with ``vec``;
    mentions; edges; nodes.
    """

    passages: DataFrame
    triples: DataFrame
    facts: DataFrame
    entities: DataFrame
    mentions: DataFrame
    edges: DataFrame
    nodes: DataFrame

    def stats(self) -> DataFrame:
        return ingest.store_stats(self.passages, self.entities, self.facts, self.nodes)

    def forget(self, as_of_ms, config: MemoryConfig = DEFAULT) -> "Memory":
        gone = materialize(
            forgetting.forget_candidates(self.passages, as_of_ms, config).select("store_id", "passage_seq")
        )
        left = forgetting.remove_passages(
            gone, self.passages, self.triples, self.mentions, self.entities, self.facts, self.edges
        )
        nodes = graph.graph_nodes(left.entities, left.passages)
        return Memory(*left[:2], left.facts, left.entities, left.mentions, left.edges, nodes)

    def materialized(self) -> "Memory":
        return replace(self, **{k: materialize(v) for k, v in self.__dict__.items()})

    def write(self, path: str) -> None:
        for name, df in self.__dict__.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark, path: str) -> "Memory":
        return Memory(**{n: spark.read.parquet(f"{path}/{n}") for n in Memory.__dataclass_fields__})


def link_graph(
    triples: DataFrame, mentions: DataFrame, entities: DataFrame, passages: DataFrame,
    config: MemoryConfig = DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    """Edges as sequential indexing would leave them, and nodes."""
    writes = materialize(graph.synonym_writes(entities, config))
    edges = graph.ledger_edges(triples, writes).unionByName(graph.passage_edges(mentions))
    return edges, graph.graph_nodes(entities, passages)


def index_exchanges(
    exchanges: DataFrame,
    order: list[str],
    extractor: Extractor,
    embedder: Embedder,
    timestamp_ms: str | None = None,
    config: MemoryConfig = DEFAULT,
    link: bool = True,
) -> Memory:
    """Index ``exchanges(store_id, *order, text)`` in ``order``, numbered from 0 per store.

    Without ``link`` there are no edges, for a memory that is cut by ``bounded_memory`` next. The stored and embedded passage text is the extractor's summary. Provider results are
    written out once, so no later stage repeats a model call.
    """
    m = LazyMemory(exchanges, order, extractor, embedder, timestamp_ms, config)
    if link:
        return Memory(m.passages, m.triples, m.facts, m.entities, m.mentions, m.edges, m.nodes)
    none = m.mentions.select("store_id", F.col("entity").alias("src"), F.col("entity").alias("dst"), F.lit(0.0).alias("w")).limit(0)
    return Memory(m.passages, m.triples, m.facts, m.entities, m.mentions, none, m.nodes)


class LazyMemory:
    """The tables of ``index_exchanges``, each built and written out when it is first asked for.

    A caller that reads only facts pays for no graph, one that reads only ``summaries`` (passages without ``vec``) for no
    embedding. Texts are extracted once, and every passage, entity and fact is embedded once.
    """

    def __init__(
        self, exchanges: DataFrame, order: list[str], extractor: Extractor, embedder: Embedder,
        timestamp_ms: str | None = None, config: MemoryConfig = DEFAULT,
    ):
        self._exchanges, self._order, self._timestamp = exchanges, order, timestamp_ms
        self._extractor, self._embedder, self._config = extractor, embedder, config

    @cached_property
    def _read(self) -> DataFrame:
        ship_package(self._exchanges.sparkSession)
        stamp = F.col(self._timestamp) if self._timestamp else F.lit(0)
        # extraction runs where the texts are read; only its results are moved to be numbered
        read = materialize(
            spread(self._exchanges).select(
                "store_id", *self._order, stamp.cast("bigint").alias("timestamp_ms"),
                utf16_left(F.col("text"), 50).alias("head"), self._extractor.column(F.col("text")).alias("x"),
            )
        )

        def numbered() -> DataFrame:
            rows = ordinals(read, ["store_id"], self._order, "passage_seq", self._config.ordinal_wide_rows)
            return rows.select(
                "store_id", "passage_seq", passage_key(F.col("passage_seq"), F.col("head")).alias("passage_id"),
                "timestamp_ms", "x",
            )

        table = settled(numbered)
        discard(read)  # one copy of the results is left
        return table

    def _embedded(self, df: DataFrame, text: str) -> DataFrame:
        return materialize(df.withColumn("vec", self._embedder.column(F.col(text))))

    @cached_property
    def summaries(self) -> DataFrame:
        return self._read.select(
            "store_id", "passage_seq", "passage_id", F.col("x.summary").alias("text"), "x.types", "x.topics",
            "x.salience", "timestamp_ms", F.lit(0).cast("bigint").alias("access_count"),
            F.lit(0).cast("bigint").alias("last_accessed_ms"),
        )

    @cached_property
    def passages(self) -> DataFrame:
        return self._embedded(self.summaries, "text")

    @cached_property
    def triples(self) -> DataFrame:
        return ingest.explode_triples(self._read.select("store_id", "passage_seq", F.col("x.triples").alias("triples")))

    @cached_property
    def facts(self) -> DataFrame:
        return self._embedded(ingest.build_facts(self.triples), "fact")

    @cached_property
    def entities(self) -> DataFrame:
        return self._embedded(ingest.build_entities(self.triples), "entity")

    @cached_property
    def mentions(self) -> DataFrame:
        return materialize(ingest.build_mentions(self.triples))

    @cached_property
    def _graph(self) -> tuple[DataFrame, DataFrame]:
        made = self.triples, self.mentions, self.entities, self.summaries
        return settled(lambda: link_graph(*made, self._config)[0]), self.nodes

    @cached_property
    def edges(self) -> DataFrame:
        return self._graph[0]

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.graph_nodes(self.entities, self.summaries)


def bounded_memory(memory: Memory, flushes: DataFrame, accesses: DataFrame | None = None, config: MemoryConfig = DEFAULT) -> Memory:
    """What is left of ``memory`` if its passages were indexed flush by flush and every flush forgot down to capacity.

    ``memory`` has all passages that were ever indexed, ``flushes(store_id, passage_seq, flush, flush_ms)`` says when, with later
    passages in later flushes. Equals indexing and forgetting step by step: a fact or entity that came back counts from then on,
    and edges lost with a node stay lost.
    """
    key = ["store_id", "passage_seq"]
    stamped = memory.passages.drop("timestamp_ms").join(flushes.select(*key, "flush", F.col("flush_ms").alias("timestamp_ms")), key)
    stamped = materialize(stamped)
    lives = materialize(lifetimes.passage_lifetimes(stamped.withColumn("flush_ms", F.col("timestamp_ms")), accesses, config))
    entity_lives = materialize(lifetimes.entity_lifetimes(memory.triples, lives))
    kept = materialize(lifetimes.held(lives).select(*key))
    left = lambda df: df.join(kept, key, "left_semi")
    passages, triples, mentions = left(stamped).select(*memory.passages.columns), left(memory.triples), left(memory.mentions)
    seen = lifetimes.held(entity_lives).select("store_id", "entity", F.col("seq").alias("entity_seq"), F.shiftright("seq", ingest.ORD_BITS + 1).alias("first_passage_seq"))
    entities = memory.entities.drop("entity_seq", "first_passage_seq").join(seen, ["store_id", "entity"]).select(*memory.entities.columns)
    stated = lifetimes.held(lifetimes.fact_lifetimes(memory.triples, lives)).drop("born", "died").withColumnRenamed("seq", "fact_seq")
    facts = memory.facts.drop("subject", "predicate", "object", "owner_seq", "fact_seq").join(stated, ["store_id", "fact"]).select(*memory.facts.columns)
    ledger = lifetimes.ledger_with_removals(memory.triples, memory.entities.select("store_id", "entity", "vec"), entity_lives, lives, config)
    edges = ledger.unionByName(graph.passage_edges(mentions))
    return Memory(passages, triples, facts, entities, mentions, materialize(edges), graph.graph_nodes(entities, passages))
