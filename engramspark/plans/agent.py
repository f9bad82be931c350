"""The four memory tools and the bounded tool loop of one conversation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, MAX_AGENT_ROUNDS, MemoryConfig
from ..operators.tags import list_topics
from ..session import materialize
from ..sources.providers import Embedder, TripleFilter
from .evaluate import FALLBACK_ANSWER
from .index import Memory
from .retrieve import embed_queries, format_associations, format_results, recall, recognize

NO_TOPICS = "No topics in memory yet."
NO_TOPIC_MATCH = "No matching topics found."
QUERY_ID = "q"


def explore_topics(topics: list[str], request: str, choose: Callable[[str, list[str]], list[str] | None]) -> str:
    """Relevant topics by the model's choice; the whole list when it fails or stays silent."""
    if not topics:
        return NO_TOPICS
    try:
        picked = choose(request, topics)
    except Exception:
        picked = None
    if picked is None:
        return "Available topics: " + ", ".join(topics)
    return "Relevant topics: " + ", ".join(picked) if picked else NO_TOPIC_MATCH


@dataclass
class MemoryTools:
    """recognize, recall, remember and explore_topics over one store.

    ``recall`` without triples uses those of the latest ``recognize`` or ``remember``.
    """

    spark: SparkSession
    memory: Memory
    store_id: Any
    embedder: Embedder
    triple_filter: TripleFilter | None = None
    choose_topics: Callable[[str, list[str]], list[str] | None] = lambda request, topics: None
    config: MemoryConfig = DEFAULT
    last_recognized: DataFrame | None = None
    trace: list[dict] = field(default_factory=list)

    def _query(self, query: str, types=None, topics=None) -> DataFrame:
        row = self.spark.createDataFrame(
            [(QUERY_ID, query, types, topics)],
            "query_id string, query_text string, type_filter array<string>, topic_filter array<string>",
        )
        store = F.lit(self.store_id).cast(self.memory.passages.schema["store_id"].dataType)
        return embed_queries(row.withColumn("store_id", store), self.embedder)

    def recognize(self, query: str, type: list[str] | None = None, topics: list[str] | None = None) -> str:
        q = self._query(query, type, topics)
        self.last_recognized = materialize(recognize(self.memory, q, self.triple_filter, self.config))
        return format_associations(q, self.last_recognized).first()["associations"]

    def recall(self, query: str, triples: DataFrame | None = None, type=None, topics=None) -> str:
        q = self._query(query, type, topics)
        seeds = triples if triples is not None else self.last_recognized
        if seeds is None:
            return format_results(self.memory, q, _no_results(self.memory)).first()["context"]
        found = recall(self.memory, q, seeds, self.config)
        return format_results(self.memory, q, found).first()["context"]

    def remember(self, query: str, type: list[str] | None = None, topics: list[str] | None = None) -> str:
        q = self._query(query, type, topics)
        self.last_recognized = materialize(recognize(self.memory, q, self.triple_filter, self.config))
        found = recall(self.memory, q, self.last_recognized, self.config)
        return format_results(self.memory, q, found).first()["context"]

    def explore_topics(self, request: str) -> str:
        mine = list_topics(self.memory.passages.where(F.col("store_id") == F.lit(self.store_id)))
        # the prompt for one chat model call, so the topic list has to fit its window
        names = [r["topic"] for r in mine.orderBy("topic").toLocalIterator()]
        return explore_topics(names, request, self.choose_topics)

    def call(self, name: str, args: dict) -> str:
        tools = {"recognize": self.recognize, "recall": self.recall,
                 "remember": self.remember, "explore_topics": self.explore_topics}
        result = tools[name](**args) if name in tools else f"Unknown tool: {name}"
        self.trace.append({"tool": name, "args": args, "result": result})
        return result


def _no_results(memory: Memory) -> DataFrame:
    return memory.passages.where(F.lit(False)).select(
        "store_id", F.lit(QUERY_ID).alias("query_id"), "passage_seq",
        F.lit(0.0).alias("score"), F.lit(1).alias("rank"),
    )


def run_agent(tools: MemoryTools, model: Callable[[list[dict]], dict], question: str) -> str:
    """Let ``model(messages)`` call tools for up to six rounds; calls of a round run in order.

    A reply is ``{"content": str, "tool_calls": [{"id", "name", "args"}]}``.
    """
    messages: list[dict] = [{"role": "user", "content": question}]
    for _ in range(MAX_AGENT_ROUNDS):
        reply = model(messages)
        if not reply.get("tool_calls"):
            return reply.get("content") or FALLBACK_ANSWER
        messages.append({"role": "assistant", **reply})
        for call in reply["tool_calls"]:
            messages.append({"role": "tool", "id": call.get("id"), "content": tools.call(call["name"], call["args"])})
    return FALLBACK_ANSWER
