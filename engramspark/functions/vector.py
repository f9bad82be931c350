"""Vector expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a.cast("array<double>"), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for unequal lengths, empty vectors and zero norms."""
    scale = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0)
    return F.when(usable, dot(a, b) / F.nullif(scale, F.lit(0.0))).otherwise(F.lit(0.0))


def min_max(value: Column, lo: Column, hi: Column) -> Column:
    span = hi - lo
    return F.when(span == 0, F.lit(0.0)).otherwise((value - lo) / F.nullif(span, F.lit(0.0)))


def min_max_normalize(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Scale ``value`` to [0,1] within each key.

    Extremes come from a partially aggregated groupBy joined back, not from a
    window: a window would bring every row of a hot key into a single task.
    """
    ext = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return (
        df.join(ext, keys)
        .withColumn(out, min_max(F.col(value), F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )
