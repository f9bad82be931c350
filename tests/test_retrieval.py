import pytest
from pyspark.sql import functions as F

from engramspark.config import MemoryConfig
from engramspark.functions.text import verdict_is_correct
from engramspark.operators import chunking
from engramspark.plans import agent, evaluate, index, retrieve
from engramspark.sources.providers import (
    ContainsJudge, HashEmbedder, KeywordExtractor, ProviderRegistry, RemoteEmbedder, RemoteExtractor, RemoteJudge,
    RemoteReranker, RemoteTripleFilter, with_retry,
)

TEXTS = [
    "alice bought cycling shoes. alice cycling alice shoes shoes", "marcus visits brookside kitchen kitchen brookside 12",
    "alice visits brookside brookside alice", "planet jupiter orbits planet jupiter?",
]


@pytest.fixture(scope="module")
def memory(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(TEXTS)] + [(2, 0, "lonely words together")],
                               "store_id int, at int, text string")
    return index.index_exchanges(df, ["at"], KeywordExtractor(), HashEmbedder()).materialized()


def ask(spark, *rows):
    q = spark.createDataFrame(list(rows), "store_id int, query_id int, query_text string, type_filter array<string>, topic_filter array<string>")
    return retrieve.embed_queries(q, HashEmbedder())


def test_index_tables(memory):
    stats = {r.store_id: (r.passages, r.graph_nodes) for r in memory.stats().collect()}
    assert stats[1][0] == 4 and stats[1][1] == 4 + memory.entities.where("store_id = 1").count()
    p = {r.passage_seq: r for r in memory.passages.where("store_id = 1").collect()}
    assert p[0].topics[0] == "alice" and p[1].types == ["event"] and p[3].types == ["goal"] and p[0].types == ["fact"]


def test_retrieval_finds_the_subject(spark, memory):
    q = ask(spark, (1, 1, "alice cycling", None, None), (1, 2, "jupiter planet", None, None), (1, 3, "", None, None))
    got = retrieve.retrieve(memory, q).where("rank = 1").collect()
    assert {r.query_id: r.passage_seq for r in got} == {1: 0, 2: 3}
    loop = retrieve.retrieve(memory, q, method="loop").where("rank = 1").collect()
    assert {r.query_id: r.passage_seq for r in loop} == {1: 0, 2: 3}


def test_large_and_small_stores_take_both_ways(spark, memory):
    q = ask(spark, (1, 1, "alice cycling", None, None), (1, 2, "jupiter", ["goal", "event"], None),
            (2, 3, "lonely words", None, None), (2, 4, "together", ["fact"], ["lone"]))
    sizes = {r.store_id: r["count"] for r in memory.edges.groupBy("store_id").count().collect()}
    split = MemoryConfig(kernel_max_edges=sizes[2])
    assert sizes[1] > sizes[2]
    pick = lambda df: sorted((r.store_id, r.query_id, r.passage_seq, r["rank"], round(r.score, 9)) for r in df.collect())
    want = pick(retrieve.retrieve(memory, q, method="kernel"))
    assert want and pick(retrieve.retrieve(memory, q, None, split)) == want
    assert pick(retrieve.retrieve(memory, q, method="loop")) == want


def test_filters_keep_the_first_survivor_below_the_ratio(spark, memory):
    q = ask(spark, (1, 1, "alice cycling", ["goal"], None))
    seeds = retrieve.recognize(memory, ask(spark, (1, 1, "alice cycling", None, None)))
    got = retrieve.recall(memory, q, seeds).collect()
    assert [(r.passage_seq, r["rank"]) for r in got] == [(3, 1)]
    none = retrieve.recognize(memory, ask(spark, (1, 1, "alice", ["plan"], None)))
    assert none.count() == 0


def test_one_fact_store_returns_zero_scores_in_order(spark):
    df = spark.createDataFrame([(1, 0, "onlyword otherword")], "store_id int, at int, text string")
    m = index.index_exchanges(df, ["at"], KeywordExtractor(), HashEmbedder())
    got = retrieve.retrieve(m, ask(spark, (1, 1, "onlyword", None, None))).collect()
    assert [(r.passage_seq, r.score) for r in got] == [(0, 0.0)]


def test_no_seeds_and_the_dense_option(spark, memory):
    q = ask(spark, (1, 1, "alice cycling", None, None))
    empty = retrieve.recognize(memory, q).where(F.lit(False))
    assert retrieve.recall(memory, q, empty).count() == 0
    assert retrieve.recall(memory, q, empty, dense_fallback=True).orderBy("rank").first()["passage_seq"] == 0


class Fixed:
    def __init__(self, positions):
        self.list = positions

    def positions(self, query, candidates):
        return F.array(*[F.lit(p) for p in self.list])


def test_recognition_positions_keep_order_repeats_and_range(spark, memory):
    q = ask(spark, (1, 1, "alice cycling", None, None), (2, 2, "lonely", None, None))
    every = [tuple(r)[3:] for r in retrieve.recognize(memory, q).where("query_id = 1").orderBy("pos").collect()]
    got = retrieve.recognize(memory, q, Fixed([3, 1, 1, 99, 0]))
    assert [tuple(r)[3:] for r in got.where("query_id = 1").orderBy("pos").collect()] == [every[2], every[0], every[0]]
    assert got.where("query_id = 2").count() == 2  # two candidates pass unfiltered


def test_formatting(spark, memory):
    q = ask(spark, (1, 1, "alice cycling", None, None), (1, 2, "zzz", None, None))
    hits = spark.createDataFrame([(1, 1, 1, 2), (1, 1, 0, 1)], "store_id int, query_id int, passage_seq bigint, rank int")
    got = {r.query_id: r.context for r in retrieve.format_results(memory, q, hits).collect()}
    assert got[2] == "No relevant memories found." and got[1].startswith("[Memory 1] [fact] [alice,")
    assert "\n\n[Memory 2] [event] [" in got[1]


def test_forget_and_stats(memory):
    left = memory.forget(10**12, MemoryConfig(max_passages=3))
    assert {r.store_id: r.passages for r in left.stats().collect()} == {1: 3, 2: 1}


def test_write_and_read(spark, memory, tmp_path):
    memory.write(str(tmp_path / "m"))
    assert index.Memory.read(spark, str(tmp_path / "m")).edges.count() == memory.edges.count()


def test_tools_and_agent_loop(spark, memory):
    tools = agent.MemoryTools(spark, memory, 1, HashEmbedder(), choose_topics=lambda request, topics: [topics[0]])
    assert tools.recall("alice cycling") == "No relevant memories found."
    assert tools.recognize("alice cycling").startswith("1. (")
    assert tools.recall("alice cycling").startswith("[Memory 1]")
    script = [
        {"tool_calls": [{"id": "a", "name": "remember", "args": {"query": "jupiter planet"}},
                        {"id": "b", "name": "explore_topics", "args": {"request": "any"}},
                        {"id": "c", "name": "other", "args": {}}]},
        {"content": "It orbits."},
    ]
    seen = []

    def model(messages):
        seen.append(len(messages))
        return script[len(seen) - 1]

    assert agent.run_agent(tools, model, "what orbits?") == "It orbits."
    assert seen == [1, 5]
    assert tools.trace[-1]["result"] == "Unknown tool: other" and tools.trace[-2]["result"].startswith("Relevant topics: ")
    endless = {"tool_calls": [{"name": "other", "args": {}}]}
    assert agent.run_agent(tools, lambda m: endless, "x").startswith("I'm having trouble")


def test_explore_topics_sentinels():
    assert agent.explore_topics([], "r", None) == "No topics in memory yet."
    assert agent.explore_topics(["a", "b"], "r", lambda r, t: None) == "Available topics: a, b"
    assert agent.explore_topics(["a"], "r", lambda r, t: []) == "No matching topics found."
    assert agent.explore_topics(["a"], "r", lambda r, t: 1 / 0) == "Available topics: a"


def test_evaluation_run(spark):
    turns = spark.createDataFrame(
        [("q1", 0, 0, "user", "alice adores cycling shoes", "d"), ("q1", 0, 1, "assistant", "cycling noted", "d"),
         ("q2", 0, 0, "user", "nothing relevant whatsoever", "d")],
        "store_id string, session_index int, pos int, role string, content string, session_date string")
    items = spark.createDataFrame([("q1", "t", "alice cycling shoes", "cycling"), ("q2", "t", "planets", "jupiter")],
                                  "question_id string, question_type string, question string, answer string")
    run = evaluate.run_evaluation(items, turns, KeywordExtractor(), HashEmbedder(), ContainsJudge())
    assert {r.question_id: r.correct for r in run.results.collect()} == {"q1": True, "q2": False}


def test_retries_wait_only_for_rate_limits():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise RuntimeError("429 Too Many Requests")
        return x

    assert with_retry(flaky, 5, sleep=waits.append) == 5 and waits == [20.0, 40.0]
    with pytest.raises(ValueError):
        with_retry(lambda: (_ for _ in ()).throw(ValueError("no")), sleep=waits.append)
    with pytest.raises(RuntimeError):
        with_retry(lambda: (_ for _ in ()).throw(RuntimeError("429")), sleep=waits.append)
    assert waits == [20.0, 40.0, 20.0, 40.0, 60.0]


def test_remote_providers(spark):
    def call(text):
        if "bad" in text:
            raise RuntimeError("down")
        return {"summary": " S ", "triples": [{"subject": " Bob", "predicate": "Likes", "object": "Tea "}],
                "types": ["goal", "zz"], "topics": ["Tea"], "salience": 3.0}

    df = spark.createDataFrame([("good",), ("bad" + "x" * 300,)], "t string")
    good, bad = df.select(RemoteExtractor(call).column(F.col("t")).alias("x")).collect()
    assert (good.x.failed, bad.x.failed) == (False, True)
    assert good.x.summary == "S" and tuple(good.x.triples[0]) == ("bob", "likes", "tea")
    assert (good.x.types, good.x.topics, good.x.salience) == (["goal"], ["tea"], 1.0)
    assert (len(bad.x.summary), bad.x.triples, bad.x.types, bad.x.salience) == (200, [], ["fact"], 0.5)
    e = RemoteEmbedder(lambda texts, kind: [[float(len(t)), 1.0] for t in texts], batch=1)
    assert [r[0] for r in df.limit(1).select(e.column(F.col("t"), "query")).collect()] == [[4.0, 1.0]]
    with pytest.raises(KeyError):
        ProviderRegistry()["nope"]


def test_remote_filter_judge_and_reranker(spark):
    def choose(query, lines):
        if query == "bad":
            raise RuntimeError("down")
        return [i + 1 for i, line in enumerate(lines) if query in line]

    triple = lambda s: {"subject": s, "predicate": "has", "object": "x"}
    df = spark.createDataFrame(
        [(1, "tea", [triple(s) for s in ("tea", "mug", "green tea")]), (2, "bad", [triple(s) for s in "abc"]), (3, "tea", [triple("a"), triple("b")])],
        "id int, q string, c array<struct<subject:string,predicate:string,object:string>>")
    got = df.select("id", RemoteTripleFilter(choose).positions(F.col("q"), F.col("c")).alias("p")).collect()
    assert {r.id: r.p for r in got} == {1: [1, 3], 2: None, 3: None}
    qa = spark.createDataFrame([("q", "tea", "green tea"), ("q", "tea", "coffee"), ("bad", "tea", "tea")], "q string, e string, a string")
    judge = RemoteJudge(lambda q, e, a: {"bad": None}[q] if q == "bad" else "CORRECT" if e in a else "INCORRECT")
    broken = RemoteJudge(lambda q, e, a: 1 / 0)
    replies = qa.select(verdict_is_correct(judge.reply(F.col("q"), F.col("e"), F.col("a"))).alias("v"), verdict_is_correct(broken.reply(F.col("q"), F.col("e"), F.col("a"))).alias("w")).collect()
    assert [r.v for r in replies][:2] == [True, False] and not any(r.w for r in replies)
    passages = spark.createDataFrame([(1, i, "y " * 1500 + f"n{i}") for i in range(4)], "query_id int, passage_idx int, text string")
    queries = spark.createDataFrame([(1, "which")], "query_id int, query_text string")
    scorer = RemoteReranker(lambda q, chunks: [float(c[-1]) if c[-1].isdigit() else -1.0 for c in chunks])
    packed = chunking.rerank_and_pack(queries, passages, scorer, budget=300).first().context
    assert packed.endswith("n3") or packed.split("\n\n")[0].endswith("n3")
    assert ProviderRegistry()["reranker"] is not None
