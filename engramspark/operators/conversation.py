"""Turns to exchanges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import ordinals

SESSION_KEYS = ("store_id", "session_index")


def exchange_text(user: Column, assistant: Column, date: Column | None = None) -> Column:
    """``[Session: d]`` line when dated, the user part, and the assistant part when present."""
    parts = [F.concat(F.lit("User: "), F.coalesce(user, F.lit("")))]
    if date is not None:
        dated = F.concat(F.lit("[Session: "), date, F.lit("]\n"))
        parts.insert(0, F.when(F.coalesce(date, F.lit("")) != "", dated).otherwise(F.lit("")))
    parts.append(
        F.when(assistant.isNotNull(), F.concat(F.lit("\nAssistant: "), assistant)).otherwise(F.lit(""))
    )
    return F.concat(*parts)


def pair_turns(
    turns: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    pairing: str = "positional",
    with_date: bool = False,
) -> DataFrame:
    """Pair turns (2k, 2k+1) of each session into exchange k.

    Input ``turns(keys, pos, role, content)`` with ``pos`` dense from 0. An odd tail has no
    assistant part. ``pairing='skip_system'`` drops system turns and renumbers first;
    the positional default keeps them, which shifts roles when a session opens with one.
    """
    keys = list(keys)
    if pairing == "skip_system":
        turns = ordinals(turns.where(F.col("role") != "system"), keys, ["pos"], "pos2")
        turns = turns.drop("pos").withColumnRenamed("pos2", "pos")
    first = F.col("pos") % 2 == 0
    aggs = [
        F.max(F.when(first, F.col("content"))).alias("user_text"),
        F.max(F.when(~first, F.col("content"))).alias("assistant_text"),
    ]
    if with_date:
        aggs.append(F.max("session_date").alias("session_date"))
    index = F.floor(F.col("pos") / 2).cast("bigint").alias("exchange_index")
    paired = turns.groupBy(*keys, index).agg(*aggs)
    date = F.col("session_date") if with_date else None
    return paired.withColumn(
        "exchange_text", exchange_text(F.col("user_text"), F.col("assistant_text"), date)
    )


def turn_pair_counts(turns: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Exchanges per store: the sum over sessions of half the turns, rounded up."""
    per_session = turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_session.groupBy(keys[0]).agg(
        F.sum(F.ceil(F.col("_n") / 2)).cast("bigint").alias("turn_pairs"),
        F.count(F.lit(1)).alias("sessions"),
    )
