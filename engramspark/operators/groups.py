"""Helpers for work that needs a whole (bounded) group or a position inside one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..config import DEFAULT
from ..session import lookup, materialize, ship_package

OUTPUT_ROWS = 20_000


def _starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    n = batch.num_rows
    change = np.zeros(n - 1, dtype=bool)
    for k in keys:
        col = batch.column(batch.schema.get_field_index(k))
        differs = pc.not_equal(col.slice(1), col.slice(0, n - 1))
        change |= pc.fill_null(differs, True).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def map_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    fn: Callable[[pa.Table], dict | Iterator[dict] | None],
    schema: str | StructType,
) -> DataFrame:
    """Run ``fn`` once per key group over sorted Arrow batches; it may return its rows in parts.

    Spark shuffles by ``keys`` and sorts; each task then walks its partition and hands
    ``fn`` one group at a time, so thousands of small groups share one Arrow stream
    instead of paying a Python round trip each. Callers keep groups bounded by making
    a block number part of the key. Key columns must not be null.
    """
    out_type = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow_schema = to_arrow_schema(out_type)
    ship_package(df.sparkSession)
    key_list = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_parts: list[pa.RecordBatch] = []
        open_key: tuple | None = None
        done: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done, rows
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches(OUTPUT_ROWS)
            done, rows = [], 0

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if not open_parts:
                return
            result = fn(pa.Table.from_batches(open_parts))
            for part in () if result is None else (result,) if isinstance(result, dict) else result:
                rb = pa.RecordBatch.from_pydict({f.name: part[f.name] for f in arrow_schema}, schema=arrow_schema)
                done.append(rb)
                rows += rb.num_rows
                if rows >= OUTPUT_ROWS:
                    yield from flush()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            starts = _starts(batch, key_list)
            ends = np.append(starts[1:], batch.num_rows)
            for a, b in zip(starts.tolist(), ends.tolist()):
                key = tuple(batch.column(k)[a].as_py() for k in key_list)
                if key != open_key:
                    yield from finish()
                    open_parts, open_key = [], key
                open_parts.append(batch.slice(a, b - a))
        yield from finish()
        yield from flush()

    arranged = df.repartition(*key_list).sortWithinPartitions(*key_list, *order)
    return arranged.mapInArrow(run, out_type)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Size of the largest key group; only key columns are read and one number returns."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def ordinals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    out: str,
    limit: int = DEFAULT.ordinal_group_rows,
) -> DataFrame:
    """Add the 0-based position of each row in its group.

    ``order`` must be unique within a group. Groups within ``limit`` use a window.
    Larger ones are range partitioned on the sort key, so a hot group spreads over many
    tasks; a position is then the offset inside the partition plus the number of rows
    the group has in earlier partitions.
    """
    key_list = list(keys)
    if largest_group(df, key_list) <= limit:
        w = Window.partitionBy(*key_list).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
    placed = materialize(
        df.repartitionByRange(*key_list, *order)
        .sortWithinPartitions(*key_list, *order)
        .withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_mid", 33))
    before = Window.partitionBy(*key_list).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        placed.groupBy(*key_list, "_part")
        .agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    # one row per group and partition at most, and null keys are groups too
    offsets = lookup(offsets.toDF(*[f"_k{i}" for i in range(len(key_list))], "_at", "_first", "_skip"))
    same = F.col("_part") == F.col("_at")
    for i, c in enumerate(key_list):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return (
        placed.join(offsets, same)
        .withColumn(out, (F.col("_mid") - F.col("_first") + F.col("_skip")).cast("bigint"))
        .drop("_mid", "_part", "_first", "_skip", "_at", *[f"_k{i}" for i in range(len(key_list))])
    )


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key.

    The rank filter sits directly on the window so Spark limits each group before the
    shuffle; a hot key then sends at most ``k`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
