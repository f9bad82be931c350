"""Connected components of large graphs by alternating stars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, node, root)`` for every node of ``edges(keys, a, b)``: the least node it is linked with, itself included.

    A large star links a node's greater neighbours to the least one around it, a small star its lesser ones; together they
    shrink every component to one star in a number of rounds that grows with the square of a logarithm at most. Neighbours are
    never collected: a round is two aggregates and two joins, and ends in a checkpoint. Self-links add their node alone.
    """
    keys = list(keys)
    both = edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v"))
    nodes = materialize(both.select(*keys, F.explode(F.array("u", "v")).alias("node")).distinct())
    # greater node first
    links = materialize(
        both.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = None
    while True:
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == state:
            break
        state = mark
        around = links.unionByName(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: greater neighbours of u go to the least node around u
        large = around.where("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: lesser neighbours of u, and u itself, go to the least of them
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        spread = large.join(low, [*keys, "u"])
        small = spread.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(*keys, "u", F.col("m").alias("v")))
        links = materialize(small.where("u <> v").distinct())
    roots = links.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, [*keys, "node"], "left").select(*keys, "node", F.coalesce("root", "node").alias("root"))
