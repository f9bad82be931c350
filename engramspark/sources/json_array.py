"""Elements of JSON array files in file order, read by many tasks.

A file is cut at every comma, at whatever bytes a split begins. Whether a piece begins inside a string, and how deep, follows from the
quotes and brackets before it: pieces are summed up per split, splits are chained (a few numbers each), and commas at depth one
outside strings turn out to be the borders of elements. Nothing needs a whole file in one task, and only built-in
functions and Spark's own reader are used, so any file system that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators.groups import ordinals
from ..session import materialize


def _depth(parts: Column, odd: int) -> Column:
    """Brackets opened less brackets closed in every second part of a piece cut at its quotes."""
    text = F.array_join(F.filter(parts, lambda x, i: i % 2 == odd), "")
    count = lambda mark: F.length(F.regexp_replace(text, f"[^{mark}]", ""))
    return (count(r"\[{") - count(r"\]}")).cast("bigint")


def array_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(pos, json)`` of all elements of the array files under ``path``; files follow each other by name, ``pos`` is dense from 0.

    A file may also hold one object; its values are the elements, those with whole numbers as keys first and by number, the
    others in file order. Elements can be of any JSON type. An empty array has none.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = pieces.withColumn("at", F.monotonically_increasing_id())
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    sized = pieces.withColumns({"quotes": (F.size(parts) - 1).cast("bigint"), "d0": _depth(parts, 0), "d1": _depth(parts, 1)})
    w = Window.partitionBy("file", "block").orderBy("at")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    even = none(F.sum("quotes").over(before)) % 2 == 0
    placed = sized.withColumn("even", even)
    # depth changes if the split begins outside a string (s0) or inside one (s1)
    for name, a, b in (("s0", "d0", "d1"), ("s1", "d1", "d0")):
        placed = placed.withColumn(name, F.when(F.col("even"), F.col(a)).otherwise(F.col(b)))
    placed = materialize(placed.withColumns({"b0": none(F.sum("s0").over(before)), "b1": none(F.sum("s1").over(before))}))
    splits = placed.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
    files = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    chained = splits.withColumn("outside", none(F.sum("quotes").over(files)) % 2 == 0)
    chained = chained.withColumn("change", F.when(F.col("outside"), F.col("s0")).otherwise(F.col("s1")))
    chained = chained.select("file", "block", "outside", none(F.sum("change").over(files)).alias("depth"))
    known = placed.join(F.broadcast(chained) if _few(chained) else chained, ["file", "block"])
    free = F.col("even") == F.col("outside")
    deep = F.col("depth") + F.when(F.col("outside"), F.col("b0")).otherwise(F.col("b1"))
    # depth 0 is only that of a file's first piece
    known = known.withColumn("border", (free & (deep <= 1)).cast("bigint"))
    known = known.withColumn("mine", F.sum("border").over(w))
    counts = known.groupBy("file", "block").agg(F.sum("border").alias("n")).withColumn("skip", none(F.sum("n").over(files))).drop("n")
    numbered = known.join(F.broadcast(counts) if _few(counts) else counts, ["file", "block"]).withColumn("element", F.col("skip") + F.col("mine") - 1)
    # an element is one value of a row, as anywhere; its pieces meet by its own number
    whole = numbered.groupBy("file", "element").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"))
    text = whole.select("file", "element", F.array_join(F.transform("p", lambda x: x["value"]), ",").alias("json"))
    ends = numbered.groupBy("file").agg(F.max("element").alias("last"), F.min_by(F.substring(F.ltrim("value"), 1, 1), F.struct("block", "at")).alias("kind"))
    text = text.join(F.broadcast(ends) if _few(ends) else ends, "file")
    body = F.when(F.col("element") == 0, F.regexp_replace("json", r"^\s*[\[{]", "")).otherwise(F.col("json"))
    body = F.when(F.col("element") == F.col("last"), F.regexp_replace(body, r"[\]}]\s*$", "")).otherwise(body)
    key = r'(?s)^\s*"((?:[^"\\]|\\.)*)"\s*:'
    keyed = F.col("kind") == "{"
    found = text.withColumn("body", body).select(
        "file", "element", F.when(keyed, F.regexp_extract("body", key, 1)).alias("key"), F.trim(F.when(keyed, F.regexp_replace("body", key, "")).otherwise(F.col("body"))).alias("json")
    ).where(F.length(F.regexp_replace("json", r"\s", "")) > 0)
    number = F.when(F.col("key").rlike("^(0|[1-9][0-9]{0,8})$"), F.col("key").cast("bigint"))
    found = found.select("json", F.lit(0).alias("all"), F.struct("file", number.isNull().alias("named"), number.alias("number"), "element").alias("place"))
    return ordinals(found, ["all"], ["place"], "pos", DEFAULT.ordinal_wide_rows).select("pos", "json")


def _few(df: DataFrame, limit: int = 200_000) -> bool:
    """Whether a table of a row per split or file is small enough to be sent to all tasks."""
    return df.limit(limit + 1).count() <= limit
