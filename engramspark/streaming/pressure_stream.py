"""The pressure fold as a stateful stream: one state row per conversation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import LINT_EVERY
from ..operators.pressure import LIMIT, SUMMARY_HEAD
from ..session import ship_package

STATE = "buffer string, pending array<string>, pressure bigint, flushed bigint"
FLUSH = (
    "store_id string, flush_no bigint, passage_seq bigint, exchange_text string, "
    "summary string, lint boolean"
)


def utf16_len(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)


def head_summary(buffer: str) -> str:
    """Summary a compressed buffer starts with, up to the first blank line."""
    if not buffer.startswith("[Summary]"):
        return ""
    return buffer[len(SUMMARY_HEAD):].split("\n\n")[0]


def flush_stream(
    exchanges: DataFrame, summarize: Callable[[str, str], str], with_timeout_ms: int | None = None
) -> DataFrame:
    """Emit each pending exchange once its conversation's buffer overflows.

    ``exchanges(store_id, seq, exchange_text)``. ``summarize(previous, buffer)`` replaces the
    buffer. State survives restarts through the query's checkpoint; with a timeout, a
    conversation silent that long is flushed and closed, like the end of a session.
    """
    ship_package(exchanges.sparkSession)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if with_timeout_ms else GroupStateTimeout.NoTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, pending, pressure, flushed = state.get if state.exists else ("", [], 0, 0)
        pending, out = list(pending), []

        def flush(summary: str, lint: bool) -> None:
            nonlocal pending, flushed
            for text in pending:
                out.append((key[0], pressure, flushed, text, summary, lint))
                flushed += 1
            pending = []

        if state.hasTimedOut:
            flush("", True)
            state.remove()
        else:
            rows = pd.concat(batches).sort_values("seq")
            for text in rows["exchange_text"]:
                buffer = f"{buffer}\n\n{text}" if buffer else text
                pending.append(text)
                if utf16_len(buffer) > LIMIT:
                    summary = summarize(head_summary(buffer), buffer)
                    buffer = SUMMARY_HEAD + summary
                    pressure += 1
                    flush(summary, pressure % LINT_EVERY == 0)
            state.update((buffer, pending, pressure, flushed))
            if with_timeout_ms:
                state.setTimeoutDuration(with_timeout_ms)
        yield pd.DataFrame(out, columns=["store_id", "flush_no", "passage_seq", "exchange_text", "summary", "lint"])

    return (
        exchanges.select(F.col("store_id").cast("string").alias("store_id"), "seq", "exchange_text")
        .groupBy("store_id")
        .applyInPandasWithState(fold, FLUSH, STATE, "append", timeout)
    )
