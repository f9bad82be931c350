"""Conversation buffers: growth, pressure test and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BUFFER_TOKEN_LIMIT
from ..functions.text import compression_target, estimate_tokens
from ..session import materialize, ship_package

# Fixed value: the line a summary of summaries starts with.
EARLIER = "[Summary of earlier conversation]\n"


def should_summarize(buffer: Column) -> Column:
    return estimate_tokens(buffer) > BUFFER_TOKEN_LIMIT


def append_exchange(buffer: Column, exchange: Column) -> Column:
    """The buffer with one more exchange behind a blank line."""
    return F.when(F.coalesce(buffer, F.lit("")) == "", exchange).otherwise(F.concat(buffer, F.lit("\n\n"), exchange))


def summarize_exchanges(exchanges: DataFrame, summarizer, text: str = "exchange_text") -> DataFrame:
    """Add ``summary``: each exchange on its own, to about a quarter of its tokens."""
    ship_package(exchanges.sparkSession)
    return exchanges.withColumn("summary", summarizer.column(F.col(text), compression_target(F.col(text))))


def summarize_summaries(summaries: DataFrame, keys: Sequence[str], pos: str, summarizer, fan: int = 64) -> DataFrame:
    """One narrative per key (a flush or session) from its exchange summaries, ``pos`` from 0 giving their order.

    At most ``fan`` consecutive summaries join into one prompt; a longer session is summarized in rounds, so no prompt and no value
    grows with it. Every round is written once and its calls are not repeated.
    """
    ship_package(summaries.sparkSession)
    level = summaries.select(*keys, F.col(pos).cast("bigint").alias("_at"), "summary")
    left = (level.agg(F.max("_at")).first()[0] or 0) + 1
    while True:
        left = -(-left // fan)
        block = F.floor(F.col("_at") / fan).cast("bigint").alias("_at")
        joined = level.groupBy(*keys, block).agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct(level["_at"].alias("i"), "summary"))), lambda s: s["summary"]), "\n\n"
            ).alias("joined")
        )
        level = joined.select(*keys, "_at", summarizer.column(F.col("joined"), compression_target(F.col("joined"))).alias("summary"))
        if left <= 1:
            return level.select(*keys, F.concat(F.lit(EARLIER), "summary").alias("narrative"))
        level = materialize(level)
