"""A log of calls against one agent per store."""

import random

import pytest

from engramspark.plans import agent, call_log, index
from engramspark.sources.providers import HashEmbedder, KeywordExtractor


@pytest.mark.parametrize("block", [3, 100_000])
def test_seeds_come_from_the_newest_recognize(spark, block):
    r = random.Random(block)
    rows = [(s, 7 * i + 2, r.choice(["recognize", "recall", "recall"])) for s in ("x", "y", "z") for i in range(r.randrange(1, 60))]
    got = {(x.store_id, x.op_no): x.source_op for x in call_log.seed_sources(spark.createDataFrame(rows, "store_id string, op_no bigint, kind string"), block).collect()}
    for s, at, _ in rows:
        assert got[s, at] == max((n for t, n, k in rows if t == s and k == "recognize" and n <= at), default=None)


def test_log_equals_agents(spark):
    texts = ["alice bought cycling shoes. alice cycling alice shoes shoes", "marcus visits brookside kitchen kitchen brookside", "planet jupiter orbits planet jupiter"]
    docs = spark.createDataFrame([(s, i, t) for s in ("a", "b") for i, t in enumerate(texts[: 3 if s == "a" else 2])], "store_id string, n int, text string")
    memory = index.index_exchanges(docs, ["n"], KeywordExtractor(), HashEmbedder()).materialized()
    calls = [("recall", "alice"), ("recognize", "alice cycling"), ("recall", "what did alice buy"), ("recall", "kitchen"), ("recognize", "marcus"), ("recall", "brookside")]
    log = spark.createDataFrame([(s, i, k, q) for s in ("a", "b") for i, (k, q) in enumerate(calls)], "store_id string, op_no bigint, kind string, query_text string")
    recognized, recalled = call_log.answer_log(memory, log, HashEmbedder())
    triples = {(x.store_id, x.op_no) for x in recognized.collect()}
    assert triples == {(s, i) for s in "ab" for i in (1, 4)}
    passages = {}
    for x in recalled.orderBy("rank").collect():
        passages.setdefault((x.store_id, x.op_no), []).append(x.passage_seq)
    text_of = {(x.store_id, x.passage_seq): x.text for x in memory.passages.collect()}
    for s in "ab":
        one = agent.MemoryTools(spark, memory, s, HashEmbedder())
        for i, (kind, q) in enumerate(calls):
            reply = getattr(one, kind)(q)
            if kind == "recall":
                held = passages.get((s, i), [])
                assert [text_of[s, p] in reply for p in held] == [True] * len(held)
                assert reply.count("[Memory ") == len(held)
