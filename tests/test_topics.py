"""Components against union-find, elected names against a plain version, a model asked in blocks."""

import random

from pyspark.sql import functions as F

from engramspark.operators import tags
from engramspark.operators.components import connected_components
from engramspark.operators.topics import asked_merges, similar_aliases
from engramspark.sources.providers import HashEmbedder

PASSAGES = "store_id string, passage_seq bigint, topics array<string>"


def roots(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    r = random.Random(2)
    edges = [("x", i, i + 1) for i in range(0, 120)] + [("x", r.randrange(200, 500), r.randrange(200, 500)) for _ in range(180)]
    edges += [("y", 7, n) for n in range(300)] + [("y", 900, 900), ("z", 5, 4), ("z", 4, 5)]
    got = connected_components(spark.createDataFrame(edges, "s string, a bigint, b bigint"), ["s"]).collect()
    want = {(s, n): root for s in "xyz" for n, root in roots([(a, b) for k, a, b in edges if k == s]).items()}
    assert {(x.s, x.node): x.root for x in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "s string, a bigint, b bigint"), ["s"]).count() == 0


def test_similar_names_share_the_most_used(spark):
    topics = [["property", "properties"], ["property", "Propertys", "bike"], ["bikes", "bike"], ["cedar-creek", ""], ["garden"], []]
    p = spark.createDataFrame([("s", i, t) for i, t in enumerate(topics)] + [("t", 0, ["bikes", "garden"])], PASSAGES)
    got = {(x.store_id, x.alias): x.canonical for x in similar_aliases(p, HashEmbedder(), 0.5).collect()}
    assert got == {("s", "properties"): "property", ("s", "propertys"): "property", ("s", "bikes"): "bike"}
    named = {x.passage_seq: x.topics for x in tags.consolidate_topics(p, similar_aliases(p, HashEmbedder(), 0.5)).where("store_id = 's'").collect()}
    assert named[1] == ["property", "bike"] and named[2] == ["bike"] and named[3] == ["cedar-creek", ""]


def test_a_model_is_asked_in_blocks(spark):
    def failing(topics):
        if any(t.startswith("zz") for t in topics):
            raise RuntimeError
        return [{"canonical": t[:-1], "aliases": [t]} for t in topics if t.endswith("s")] + [{"canonical": "x", "aliases": []}]

    rows = [("s", i, [f"{c}{i}", f"{c}{i}s"]) for i, c in enumerate("abcdefgh")] + [("t", 0, ["zz", "as"])]
    ask = (lambda f: lambda topics: f(topics))(failing)
    merges = asked_merges(spark.createDataFrame(rows, PASSAGES), ask, per_call=4)
    assert {(x.store_id, x.canonical, *x.aliases) for x in merges.collect()} == {("s", f"{c}{i}", f"{c}{i}s") for i, c in enumerate("abcdefgh")}
    assert merges.groupBy("store_id").agg(F.count_distinct("ord").alias("n")).first().n == 8
