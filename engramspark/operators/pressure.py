"""The memory-pressure fold over a session's exchanges.

The buffer grows by each exchange (blank line between) and collapses to a summary once it
exceeds the token limit. Only its length drives the fold, so with summaries of one known
length the state is a number between 0 and the limit. That makes a long session
splittable: each block of exchanges is reduced to its transition table (end state for
every start state), tables are chained, and all blocks are then replayed in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BUFFER_TOKEN_LIMIT, CHARS_PER_TOKEN, DEFAULT, LINT_EVERY, MemoryConfig
from ..functions.text import tokens_of_length, utf16_length
from .groups import largest_group, map_groups

SUMMARY_HEAD = "[Summary]\n"
# Fixed value: the placeholder the dashboard's estimator compresses a buffer to.
ESTIMATOR_BUFFER = "[Summary] compressed"
GLUE = 2  # the blank line between exchanges
LIMIT = BUFFER_TOKEN_LIMIT * CHARS_PER_TOKEN


def previous_summary(buffer: Column) -> Column:
    """Summary text at the head of a compressed buffer, up to the first blank line."""
    body = F.substring(buffer, F.lit(len(SUMMARY_HEAD) + 1), F.length(buffer))
    return F.when(buffer.startswith("[Summary]"), F.split(body, "\n\n", 2)[0]).otherwise(F.lit(""))


def replay(sizes: Sequence[int], start: int, compressed: int, limit: int = LIMIT):
    """Buffer length before, at peak and after each exchange, from a start length."""
    before, peak, after = [], [], []
    held = start
    for size in sizes:
        before.append(held)
        held = held + GLUE + size if held else size
        peak.append(held)
        if held > limit:
            held = compressed
        after.append(held)
    return before, peak, after


def transition(sizes: np.ndarray, compressed: int, limit: int = LIMIT):
    """End state and number of pressure events for every possible start state."""
    state = np.arange(limit + 1)
    events = np.zeros(limit + 1, dtype=np.int64)
    for size in sizes:
        state = np.where(state > 0, state + GLUE, 0) + size
        over = state > limit
        events += over
        state = np.where(over, compressed, state)
    return state, events


def pressure_trace(
    exchanges: DataFrame,
    keys: Sequence[str],
    pos: str,
    text: str = "exchange_text",
    compressed: int = len(ESTIMATOR_BUFFER),
    config: MemoryConfig = DEFAULT,
) -> DataFrame:
    """Fold each key's exchanges in ``pos`` order (dense from 0).

    Returns keys, pos, tokens before / at peak / after, ``summarized`` and
    ``events_before`` (pressure events earlier in the same fold).
    """
    if not 0 < compressed <= LIMIT:
        raise ValueError("the compressed buffer must fit the limit")
    keys = list(keys)
    sized = exchanges.select(
        *keys, F.col(pos).cast("bigint").alias(pos), utf16_length(F.col(text)).alias("size")
    ).withColumn("block", F.floor(F.col(pos) / config.fold_block).cast("bigint"))
    key_schema = ", ".join(f"{c} {sized.schema[c].dataType.simpleString()}" for c in keys)

    def replay_group(t: pa.Table) -> dict:
        before, peak, after = replay(
            t["size"].to_pylist(), t["start"][0].as_py(), compressed
        )
        over = np.asarray(peak) > LIMIT
        seen = t["start_events"][0].as_py() + np.cumsum(over) - over
        out = {c: t[c].combine_chunks() for c in [*keys, pos]}
        return out | {
            "before_len": before, "peak_len": peak, "after_len": after,
            "summarized": over, "events_before": seen,
        }

    def table_group(t: pa.Table) -> dict:
        state, events = transition(t["size"].to_numpy(), compressed)
        head = {c: [t[c][0].as_py()] for c in [*keys, "block"]}
        return head | {"ends": [state.tolist()], "counts": [events.tolist()]}

    def chain_group(t: pa.Table) -> dict:
        start, seen, starts, events = 0, 0, [], []
        for i in range(t.num_rows):
            starts.append(start)
            events.append(seen)
            ends, counts = t["ends"][i].values, t["counts"][i].values
            seen += counts[start].as_py()
            start = ends[start].as_py()
        out = {c: t[c].combine_chunks() for c in [*keys, "block"]}
        return out | {"start": starts, "start_events": events}

    if largest_group(sized, keys) <= config.fold_block:
        started = sized.withColumn("start", F.lit(0).cast("bigint")).withColumn(
            "start_events", F.lit(0).cast("bigint")
        )
    else:
        tables = map_groups(
            sized, [*keys, "block"], [pos], table_group,
            f"{key_schema}, block bigint, ends array<bigint>, counts array<bigint>",
        )
        starts = map_groups(
            tables, keys, ["block"], chain_group,
            f"{key_schema}, block bigint, start bigint, start_events bigint",
        )
        started = sized.join(starts, [*keys, "block"])
    traced = map_groups(
        started, [*keys, "block"], [pos], replay_group,
        f"{key_schema}, {pos} bigint, before_len bigint, peak_len bigint, after_len bigint, "
        "summarized boolean, events_before bigint",
    )
    return traced.select(
        *keys, pos,
        tokens_of_length(F.col("before_len")).alias("tokens_before"),
        tokens_of_length(F.col("peak_len")).alias("tokens_peak"),
        tokens_of_length(F.col("after_len")).alias("tokens_after"),
        "summarized",
        "events_before",
    )


def lint_points(trace: DataFrame) -> DataFrame:
    """Pressure events after which topics are consolidated: every third of a session."""
    return trace.where(F.col("summarized") & ((F.col("events_before") + 1) % LINT_EVERY == 0))


def prefix_sums(
    df: DataFrame, keys: Sequence[str], seq: str, values: dict[str, str], block: int
) -> DataFrame:
    """Inclusive running sums over a dense ``seq``; ``values`` maps input to output names.

    Windows cover one block of positions each; block totals are chained separately, so a
    hot key is summed by many tasks.
    """
    keys = list(keys)
    cut = df.withColumn("_block", F.floor(F.col(seq) / block).cast("bigint"))
    totals = cut.groupBy(*keys, "_block").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *keys, "_block",
        *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_b_{v}") for v in values],
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    # as many rows as groups, which no driver should build a broadcast of; the window below needs the same partitions
    out = cut.join(base.hint("merge"), [*keys, "_block"])
    for v, name in values.items():
        out = out.withColumn(name, F.col(f"_b_{v}") + F.sum(v).over(inside))
    return out.drop("_block", *[f"_b_{v}" for v in values])
