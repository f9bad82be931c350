"""Live progress of evaluation runs from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.progress import fold_progress, with_percentages


def progress_stream(events: DataFrame) -> DataFrame:
    """Current state per run; ``events(run_id, seq, event)`` streaming."""
    return with_percentages(fold_progress(events))


def publish(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each refreshed set of run states to ``path/batch=<n>``; rewriting one is harmless."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        states.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).start()
    )
