import itertools
import random

import pytest
from pyspark.sql import functions as F

from engramspark.config import MemoryConfig
from engramspark.operators import forgetting, graph, ingest, tags

WORDS = ["property", "properties", "bike", "biking", "bi", "go", "", "ab", "abc", "abd", "漢字", "漢字漢"]


def words_match(a, b):
    return a == b if min(len(a), len(b)) < 3 else a[:3] == b[:3]


def test_topic_prefix_join_equals_pairwise_comparison(spark):
    rnd = random.Random(3)
    topics = ["-".join(rnd.choices(WORDS, k=2)) for _ in range(25)]
    passages = spark.createDataFrame([(1, i, ["fact"], [t]) for i, t in enumerate(topics)],
                                     "store_id int, passage_seq bigint, types array<string>, topics array<string>")
    filters = spark.createDataFrame([(1, i, None, [t]) for i, t in enumerate(topics)],
                                    "store_id int, query_id int, type_filter array<string>, topic_filter array<string>")
    got = {(r.query_id, r.passage_seq) for r in tags.matching_passages(passages, filters).collect()}
    split = lambda t: t.replace("-", " ").split(" ")
    want = {(i, j) for (i, a), (j, b) in itertools.product(enumerate(topics), repeat=2)
            if any(words_match(x, y) for x in split(a) for y in split(b))}
    assert got == want


def test_dimensions_combine_with_and(spark):
    passages = spark.createDataFrame(
        [(1, 0, ["goal"], ["cycling"]), (1, 1, ["fact"], ["cycling"]), (1, 2, ["goal", "plan"], [])],
        "store_id int, passage_seq bigint, types array<string>, topics array<string>")
    filters = spark.createDataFrame(
        [(1, 1, ["goal"], ["cycle"]), (1, 2, ["plan", "goal"], []), (1, 3, None, ["cyc"]), (1, 4, [], None)],
        "store_id int, query_id int, type_filter array<string>, topic_filter array<string>")
    got = sorted((r.query_id, r.passage_seq) for r in tags.matching_passages(passages, filters).collect())
    assert got == [(1, 0), (2, 0), (2, 2), (3, 0), (3, 1)]


def test_consolidation_rules(spark):
    merges = spark.createDataFrame(
        [(1, 0, "Home", ["House", "flat"]), (1, 1, "bike", ["cycle"]), (1, 2, "Home", ["villa"]), (1, 3, "x", ["cycle"])],
        "store_id int, ord int, canonical string, aliases array<string>")
    passages = spark.createDataFrame(
        [(1, 0, ["VILLA", "home", "house"]), (1, 1, ["cycle", "bike", "x"]), (1, 2, []), (2, 0, ["villa"])],
        "store_id int, passage_seq bigint, topics array<string>")
    out = tags.consolidate_topics(passages, tags.alias_table(merges))
    got = {(r.store_id, r.passage_seq): r.topics for r in out.collect()}
    assert got == {(1, 0): ["home", "house"], (1, 1): ["x", "bike"], (1, 2): [], (2, 0): ["villa"]}
    two = spark.createDataFrame([(1, 0, ["villa", "cycle"])], "store_id int, passage_seq bigint, topics array<string>")
    assert tags.consolidate_topics(two, tags.alias_table(merges)).first()["topics"] == ["villa", "cycle"]


def test_forget_score(spark):
    h = 3_600_000
    df = spark.createDataFrame([(0.25, 0, 0, 0), (0.25, 0, 2, 9 * h), (1.0, 0, 0, 0)], "s double, t bigint, n bigint, a bigint")
    score = forgetting.forget_score(F.col("s"), F.col("t"), F.col("n"), F.col("a"), 10 * h)
    got = [r[0] for r in df.select(score).collect()]
    import math
    assert got == pytest.approx([0.75 * math.log(11), 0.75 * math.log(11) - 0.5, 0.0])


def test_cascade(spark):
    t = spark.createDataFrame(
        [(1, 0, 0, "a", "p", "b"), (1, 1, 0, "a", "p", "b"), (1, 0, 1, "c", "p", "d"), (1, 1, 1, "a", "q", "e")],
        "store_id int, passage_seq bigint, ord int, subject string, predicate string, object string")
    passages = spark.createDataFrame([(1, 0, 0.1, 0, 0, 0), (1, 1, 0.9, 0, 0, 0)],
        "store_id int, passage_seq bigint, salience double, timestamp_ms bigint, access_count bigint, last_accessed_ms bigint")
    mentions, entities, facts = ingest.build_mentions(t), ingest.build_entities(t), ingest.build_facts(t)
    edges = graph.fact_edges(t).unionByName(graph.passage_edges(mentions))
    gone = forgetting.forget_candidates(passages, 3_600_000, MemoryConfig(max_passages=1))
    assert [r.passage_seq for r in gone.collect()] == [0]
    left = forgetting.remove_passages(gone, passages, t, mentions, entities, facts, edges)
    assert {r.entity for r in left.entities.collect()} == {"a", "b", "e"}
    assert {r.fact: r.owner_seq for r in left.facts.collect()} == {"a p b": 0, "a q e": 1}
    weights = {(r.src, r.dst): r.w for r in left.edges.collect()}
    assert weights[("entity:a", "entity:b")] == 2.0  # surviving weights stay
    assert not any("entity:c" in k or "passage:0" in k for k in weights)
    assert forgetting.forget_candidates(passages, 1, MemoryConfig(max_passages=2)).count() == 0


def test_access_log(spark):
    p = spark.createDataFrame([(1, 0, 1, 5), (1, 1, 0, 0)], "store_id int, passage_seq bigint, access_count bigint, last_accessed_ms bigint")
    log = spark.createDataFrame([(1, 0, 9), (1, 0, 7)], "store_id int, passage_seq bigint, at_ms bigint")
    got = {r.passage_seq: (r.access_count, r.last_accessed_ms) for r in forgetting.apply_access_log(p, log).collect()}
    assert got == {0: (3, 9), 1: (0, 0)}


def test_what_stays_is_found_from_the_few_that_stay(spark, monkeypatch):
    rnd = random.Random(11)
    names = "abcdefgh"
    rows = [(s, p, o, rnd.choice(names), rnd.choice("pq"), rnd.choice(names)) for s in (1, 2) for p in range(30) for o in range(2)]
    t = spark.createDataFrame(rows, "store_id int, passage_seq bigint, ord int, subject string, predicate string, object string")
    passages = spark.createDataFrame([(s, p, rnd.random(), 0, 0, 0) for s in (1, 2) for p in range(30)],
        "store_id int, passage_seq bigint, salience double, timestamp_ms bigint, access_count bigint, last_accessed_ms bigint")
    config = MemoryConfig(max_passages=2)
    mentions = ingest.build_mentions(t)
    edges = graph.fact_edges(t).unionByName(graph.passage_edges(mentions))
    gone = forgetting.forget_candidates(passages, 3_600_000, config)
    want = forgetting.remove_passages(gone, passages, t, mentions, ingest.build_entities(t), ingest.build_facts(t), edges)
    written = []

    def counted(df, real=forgetting.materialize):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(forgetting, "materialize", counted)
    got = forgetting.keep_passages(forgetting.kept_passages(passages, 3_600_000, config), passages, t)
    for name, a, b in zip(got._fields, got, want, strict=True):
        columns = sorted(b.columns)
        assert sorted(map(tuple, a.select(*columns).collect())) == sorted(map(tuple, b.select(*columns).collect())), name
    assert written == [8]  # the triples of what stays; before: all 120, in the query
    assert got.entities.count() < 16
