"""Evaluation path: sessions to memories, snapshots, answers and verdicts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MemoryConfig
from ..functions.text import verdict_is_correct
from ..operators import lifetimes, rolling
from ..operators.conversation import SESSION_KEYS, pair_turns
from ..operators.groups import ordinals
from ..operators.ingest import build_entities, build_facts, explode_triples
from ..operators.pressure import SUMMARY_HEAD, prefix_sums, pressure_trace
from ..session import materialize
from ..sources.providers import Embedder, Extractor, Judge, TripleFilter
from .index import Memory, bounded_memory, index_exchanges
from .retrieve import embed_queries, format_results, retrieve

FALLBACK_ANSWER = "I'm having trouble recalling. Could you rephrase?"


def session_exchanges(turns: DataFrame) -> DataFrame:
    """Dated exchanges with ``passage_seq``, their position in the store from 0."""
    return ordinals(
        pair_turns(turns, SESSION_KEYS, with_date=True), ["store_id"],
        ["session_index", "exchange_index"], "passage_seq",
    )


def flush_positions(exchanges: DataFrame, trace: DataFrame) -> DataFrame:
    """How many passages a store holds after each exchange.

    Pending exchanges are indexed at a pressure event and at the end of their session, so
    the count after an exchange is that of the last event or session end up to it.
    """
    keys = list(SESSION_KEYS)
    flushed = F.when(F.col("summarized"), F.col("passage_seq") + 1)
    joined = exchanges.select(*keys, "exchange_index", "passage_seq").join(trace, [*keys, "exchange_index"])
    starts = joined.groupBy(*keys).agg(F.min("passage_seq").alias("_start"))
    events = joined.where("summarized").select(
        *keys, F.col("events_before").alias("_no"), (F.col("passage_seq") + 1).alias("_at")
    )
    # the newest event at or before an exchange is the one counted by events_before (+ itself)
    return (
        joined.withColumn("_no", F.col("events_before") - 1)
        .join(events, [*keys, "_no"], "left")
        .join(starts, keys)
        .withColumn("passages", F.coalesce(flushed, F.col("_at"), F.col("_start")))
        .drop("_no", "_at", "_start")
    )


def growth(triples: DataFrame, counts: DataFrame) -> DataFrame:
    """Entities and facts known once ``n`` passages are in: ``(store_id, n, entities, facts)``.

    ``counts(store_id, passage_seq)`` lists every passage, dense from 0.
    """
    new_e = build_entities(triples).groupBy("store_id", F.col("first_passage_seq").alias("passage_seq")).agg(
        F.count(F.lit(1)).alias("e")
    )
    new_f = build_facts(triples).groupBy("store_id", F.col("owner_seq").alias("passage_seq")).agg(
        F.count(F.lit(1)).alias("f")
    )
    key = ["store_id", "passage_seq"]
    step = counts.select(*key).join(new_e, key, "left").join(new_f, key, "left").fillna(0, ["e", "f"])
    return prefix_sums(step, ["store_id"], "passage_seq", {"e": "entities", "f": "facts"}, 100_000).select(
        "store_id", (F.col("passage_seq") + 1).alias("passages"), "entities", "facts"
    )


def turn_snapshots(
    exchanges: DataFrame, triples: DataFrame, summary: str, config: MemoryConfig = DEFAULT
) -> DataFrame:
    """Buffer tokens and memory size after every exchange, with one constant summary text.

    ``exchanges`` from ``session_exchanges``; the buffer restarts with each session.
    """
    trace = pressure_trace(
        exchanges, SESSION_KEYS, "exchange_index", compressed=len(SUMMARY_HEAD + summary), config=config
    )
    held = flush_positions(exchanges, trace)
    size = growth(triples, exchanges.select("store_id", "passage_seq"))
    return held.join(size, ["store_id", "passages"], "left").select(
        "store_id", "session_index", F.col("passage_seq").alias("turn_index"),
        "tokens_before", "tokens_peak", "tokens_after", "summarized", "passages",
        F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("facts", F.lit(0)).alias("facts"),
    )


def flush_numbers(exchanges: DataFrame, trace: DataFrame, step_ms: int) -> DataFrame:
    """``(store_id, passage_seq, flush, flush_ms)``: with which flush an exchange is indexed, and when, if an exchange takes ``step_ms``.

    Pending exchanges are indexed at the next pressure event of their session, or at its end.
    """
    keys = list(SESSION_KEYS)
    placed = exchanges.select(*keys, "exchange_index", "passage_seq").join(trace.select(*keys, "exchange_index", "events_before"), [*keys, "exchange_index"])
    units = placed.groupBy(*keys, "events_before").agg(((F.max("passage_seq") + 1) * step_ms).alias("flush_ms"))
    numbered = ordinals(units, ["store_id"], ["session_index", "events_before"], "flush")
    return placed.join(numbered, [*keys, "events_before"]).select("store_id", "passage_seq", "flush", "flush_ms")


def remembered_snapshots(
    exchanges: DataFrame, extracted: DataFrame, summarize: rolling.Rolling = rolling.keyword_rolling,
    config: MemoryConfig = DEFAULT, step_ms: int = 60_000,
) -> DataFrame:
    """Buffer tokens, summary and memory size after every exchange, with real summaries and forgetting at every flush.

    ``exchanges`` from ``session_exchanges``; ``extracted(store_id, passage_seq, triples, salience)`` of every exchange. A session's end
    is flushed after its last exchange was recorded, as what it indexes shows from the next session on.
    """
    trace = materialize(rolling.rolling_trace(exchanges, SESSION_KEYS, "exchange_index", summarize))
    flushes = materialize(flush_numbers(exchanges, trace, step_ms))
    passages = extracted.select("store_id", "passage_seq", "salience").join(flushes, ["store_id", "passage_seq"])
    lives = materialize(lifetimes.passage_lifetimes(passages.withColumn("timestamp_ms", F.col("flush_ms")), config=config))
    triples = explode_triples(extracted.select("store_id", "passage_seq", "triples"))
    size = lifetimes.sizes(
        flushes, passages=lives, entities=lifetimes.entity_lifetimes(triples, lives), facts=lifetimes.fact_lifetimes(triples, lives)
    )
    keys = list(SESSION_KEYS)
    shown = exchanges.select(*keys, "exchange_index", "passage_seq").join(trace, [*keys, "exchange_index"]).join(
        flushes.select("store_id", "passage_seq", "flush"), ["store_id", "passage_seq"]
    ).withColumn("flush", F.col("flush") - F.when(F.col("summarized"), 0).otherwise(1))
    counts = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("passages", "entities", "facts")]
    return shown.join(size, ["store_id", "flush"], "left").select(
        "store_id", "session_index", F.col("passage_seq").alias("turn_index"),
        "tokens_before", "tokens_peak", "tokens_after", "summarized", "summary", *counts,
    )


class EvalRun(NamedTuple):
    memory: Memory
    results: DataFrame


def run_evaluation(
    items: DataFrame,
    turns: DataFrame,
    extractor: Extractor,
    embedder: Embedder,
    judge: Judge,
    answer: "callable[[Column, Column], Column] | None" = None,
    triple_filter: TripleFilter | None = None,
    config: MemoryConfig = DEFAULT,
    summarize: rolling.Rolling = rolling.keyword_rolling,
    step_ms: int = 60_000,
) -> EvalRun:
    """Index every item's sessions as its own store, retrieve, answer and judge in one job.

    Exchanges are indexed when ``summarize`` replaces their buffer or their session ends, and each such flush forgets down to
    capacity, one exchange lasting ``step_ms``.

    ``items(question_id, question_type, question, answer)``. ``answer(question, context)``
    builds the reply column; by default the retrieved context itself.
    """
    exchanges = materialize(session_exchanges(turns))
    memory = index_exchanges(
        exchanges.select("store_id", "session_index", "exchange_index", F.col("exchange_text").alias("text")),
        ["session_index", "exchange_index"], extractor, embedder, config=config, link=False,
    )
    trace = materialize(rolling.rolling_trace(exchanges, SESSION_KEYS, "exchange_index", summarize))
    memory = bounded_memory(memory, materialize(flush_numbers(exchanges, trace, step_ms)), config=config)
    asked = items.select(
        F.col("question_id").alias("store_id"), F.col("question_id").alias("query_id"),
        F.col("question").alias("query_text"),
    )
    queries = embed_queries(asked, embedder)
    found = format_results(memory, queries, retrieve(memory, queries, triple_filter, config))
    reply = answer(F.col("question"), F.col("context")) if answer else F.col("context")
    results = (
        items.join(found.select(F.col("query_id").alias("question_id"), "context"), "question_id", "left")
        .withColumn("generated_answer", F.coalesce(F.nullif(reply, F.lit("")), F.lit(FALLBACK_ANSWER)))
        .withColumn("correct", verdict_is_correct(judge.reply(F.col("question"), F.col("answer"), F.col("generated_answer"))))
        .join(memory.stats().withColumnRenamed("store_id", "question_id"), "question_id", "left")
    )
    return EvalRun(memory, results)
