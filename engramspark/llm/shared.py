"""Small helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from engramspark.session import ensure_checkpoint_dir


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder as Parquet and read it from there.

    Later reads prune columns, and a lost executor costs a read instead of a recomputation.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows: Python objects of few texts exist at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
