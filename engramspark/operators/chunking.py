"""Splitting exchanges into chunks, ranking them and packing a token budget."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHARS_PER_TOKEN, CHUNK_CHARS, CHUNK_OVERLAP, DEFAULT, PACK_TOKEN_BUDGET
from ..functions.text import estimate_tokens, strip_space, utf16_left
from ..session import ship_package
from ..sources.providers import term_overlap
from .groups import ordinals, top_rows
from .pressure import prefix_sums

# Separators from coarse to fine, the half boundary and the empty answer.
SEPARATORS = ("\n\n", "\n", ". ", ", ", " ")
ASSISTANT_MARK = "\nAssistant:"
NOTHING_FOUND = "No relevant memories found."


def _pack(parts: list[str], glue: str) -> Iterator[str]:
    """Join parts greedily up to the chunk size; a part above it comes out alone."""
    held = ""
    for part in parts:
        grown = f"{held}{glue}{part}" if held else part
        if len(grown) <= CHUNK_CHARS:
            held = grown
            continue
        if held:
            yield held
        held = part
        if len(part) > CHUNK_CHARS:
            yield part
            held = ""
    if held:
        yield held


def split_units(text: str, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split on the coarsest separator present; every level adds its own overlap."""
    if len(text) <= CHUNK_CHARS:
        return [text]
    level = next((i for i, s in enumerate(separators) if s in text), None)
    if level is None:
        step = CHUNK_CHARS - CHUNK_OVERLAP
        return [text[i : i + CHUNK_CHARS] for i in range(0, len(text), step)]
    finer = separators[level + 1 :]
    pieces: list[str] = []
    for block in _pack(text.split(separators[level]), separators[level]):
        pieces += split_units(block, finer) if len(block) > CHUNK_CHARS else [block]
    return pieces[:1] + [a[-CHUNK_OVERLAP:] + b for a, b in zip(pieces, pieces[1:])]


def split_text(text: str) -> list[str]:
    """``split_units`` with lengths in UTF-16 units."""
    if not text or max(text) < "\U00010000":
        return split_units(text)
    units = array("H", text.encode("utf-16-le", "surrogatepass"))
    return [
        c.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
        for c in split_units("".join(map(chr, units)))
    ]


def chunk_exchanges(df: DataFrame, text: str) -> DataFrame:
    """One row per chunk: ``chunk_idx``, ``role`` and trimmed ``chunk``; blank ones dropped.

    User and assistant halves are split apart first, so no chunk mixes them.
    """
    ship_package(df.sparkSession)

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_text(t))

    at = F.instr(F.col(text), ASSISTANT_MARK)
    user = F.when(at > 0, F.substring(F.col(text), F.lit(1), at - 1)).otherwise(F.col(text))
    reply = F.when(at > 0, F.substring(F.col(text), at + 1, F.length(F.col(text))))
    halves = F.filter(
        F.array(
            F.struct(F.lit(0).alias("half"), F.lit("user").alias("role"), user.alias("body")),
            F.struct(F.lit(1).alias("half"), F.lit("assistant").alias("role"), reply.alias("body")),
        ),
        lambda h: h["body"].isNotNull(),
    )
    keep = [c for c in df.columns if c != text]
    flat = (
        df.select(*keep, F.explode(halves).alias("_h"))
        .select(*keep, "_h.half", "_h.role", pieces(F.col("_h.body")).alias("_p"))
        .select(*keep, "half", "role", F.posexplode("_p").alias("piece", "chunk"))
        .withColumn("chunk", strip_space(F.col("chunk")))
        .where(F.col("chunk") != "")
    )
    return flat.withColumn("chunk_idx", F.shiftleft(F.col("half").cast("bigint"), 40) + F.col("piece")).drop(
        "half", "piece"
    )


def pack_ranked(chunks: DataFrame, keys: list[str], order: list[Column], budget: int = PACK_TOKEN_BUDGET) -> DataFrame:
    """Chunks in ``order`` (unique per key) until the first one that overflows the budget.

    Empty chunks cost nothing, so no number of ranks bounds the result; running sums go block by block.
    """
    placed = ordinals(chunks.withColumn("tokens", estimate_tokens(F.col("chunk"))), keys, order, "_pos")
    summed = prefix_sums(placed, keys, "_pos", {"tokens": "used"}, DEFAULT.fold_block)
    return summed.where(F.col("used") <= budget).withColumn("rank", (F.col("_pos") + 1).cast("int")).drop("_pos")


def rerank_and_pack(
    queries: DataFrame,
    passages: DataFrame,
    scorer: Callable[[Column, Column], Column] = term_overlap,
    budget: int = PACK_TOKEN_BUDGET,
) -> DataFrame:
    """Packed context per query: ``queries(query_id, query_text)``,
    ``passages(query_id, passage_idx, text)``.

    Everything that fits is returned in natural order without ranking. Otherwise chunks
    go in by relevance; if not even the best fits, it is cut to the budget.
    """
    chunks = chunk_exchanges(passages.select("query_id", "passage_idx", "text"), "text")
    chunks = chunks.withColumn("tokens", estimate_tokens(F.col("chunk")))
    totals = chunks.groupBy("query_id").agg(F.sum("tokens").alias("total"))
    scored = (
        chunks.join(totals, "query_id").join(queries.select("query_id", "query_text"), "query_id")
        .withColumn("fits", F.col("total") <= budget)
        .withColumn("score", F.when(~F.col("fits"), scorer(F.col("query_text"), F.col("chunk"))).otherwise(F.lit(0.0)))
    )
    order = [F.desc("score"), F.col("passage_idx"), F.col("chunk_idx")]
    packed = pack_ranked(scored.drop("tokens"), ["query_id"], order, budget)
    body = packed.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda s: s["chunk"]), "\n\n").alias("context")
    )
    best = top_rows(scored, ["query_id"], order, 1).select(
        "query_id", utf16_left(F.col("chunk"), budget * CHARS_PER_TOKEN).alias("best")
    )
    return (
        queries.select("query_id").join(body, "query_id", "left").join(best, "query_id", "left")
        .select("query_id", F.coalesce("context", "best", F.lit(NOTHING_FOUND)).alias("context"))
    )
