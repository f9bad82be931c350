"""What queries leave on disk while they run."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from engramspark.config import MemoryConfig
from engramspark.operators import lifetimes, packing, pagerank, similarity
from engramspark.plans import index, retrieve
from engramspark.session import discard, ensure_checkpoint_dir, materialize, settled, stored
from engramspark.sources.providers import HashEmbedder, KeywordExtractor


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def folders(spark):
    ensure_checkpoint_dir(spark)
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return set(os.listdir(top))


def test_what_is_written_leaves_no_shuffle_files(spark):
    counted = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    for write in (materialize, stored):
        before = shuffle_files(spark)
        table = write(counted)
        until = time.time() + 20  # files go in the background
        while shuffle_files(spark) - before and time.time() < until:
            time.sleep(0.2)
        assert not shuffle_files(spark) - before
        assert table.count() == 7 and sorted(table.columns) == ["count", "k"]
    assert counted.count() == 7  # the plan itself can still run


def test_steps_of_a_settled_table_are_deleted(spark):
    before, steps = folders(spark), []

    def make():
        steps.append(materialize(spark.range(10)))
        return steps[0].where("id > 3")

    table = settled(make)
    assert len(folders(spark) - before) == 1 and table.count() == 6
    other = stored(spark.range(5))
    assert other.count() == 5 and len(folders(spark) - before) == 2
    for t in (table, other):
        discard(t)
    assert folders(spark) == before


def test_rank_steps_keep_one_state(spark):
    rng = np.random.default_rng(11)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, size=(80, 2)) if a != b})
    edges = spark.createDataFrame([(1, f"n{a}", f"n{b}", 1.0) for x, y in pairs for a, b in ((x, y), (y, x))], "store_id int, src string, dst string, w double")
    seeds = spark.createDataFrame([(1, q, f"n{q}", 1.0) for q in range(3)], "store_id int, query_id int, node string, p double")
    kept = []
    for steps in (2, 12):
        before = folders(spark)
        config = MemoryConfig(ppr_unroll=1, ppr_max_iter=steps, ppr_epsilon=0.0)
        got = {(r.query_id, r.node): r.score for r in pagerank.personalized_pagerank(edges, seeds, None, config, "loop").collect()}
        want = {(r.query_id, r.node): r.score for r in pagerank.personalized_pagerank(edges, seeds, None, config, "kernel").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
        kept.append(len(folders(spark) - before))
    assert kept[0] == kept[1]  # before: a state more for each step


def test_lives_of_rows_that_carry_their_spans(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(1 + i % 2, int(i // 3), int(i % 3), f"s{rng.integers(6)}", "p", None if i == 7 else f"o{rng.integers(5)}") for i in range(90)]
    triples = spark.createDataFrame(rows, "store_id int, passage_seq bigint, ord int, subject string, predicate string, object string")
    spans = [(s, i, i // 4, i // 4 + int(rng.integers(0, 4)) if rng.random() < 0.8 else None) for s in (1, 2) for i in range(28)]
    lives = spark.createDataFrame(spans, "store_id int, passage_seq bigint, born bigint, died bigint")
    own = triples.join(lives, ["store_id", "passage_seq"])
    pick = lambda df: sorted(map(tuple, df.collect()), key=str)
    for of in (lifetimes.entity_lifetimes, lifetimes.fact_lifetimes):
        assert pick(of(own)) == pick(of(triples, lives)) != []
        assert "SortMergeJoin" not in of(own)._jdf.queryExecution().optimizedPlan().toString()
    flushes = lives.select("store_id", F.col("born").alias("flush"))
    tables = dict(passages=lives, entities=lifetimes.entity_lifetimes(own), facts=lifetimes.fact_lifetimes(own))
    found = []
    for rounds in (1, 3):
        monkeypatch.setattr(lifetimes, "SIZE_ROUNDS", rounds)
        found.append(pick(lifetimes.sizes(flushes, **tables)))
    assert found[0] == found[1]
    held = lifetimes.held(tables["facts"], 5).where("store_id = 1").count()
    assert next(r for r in found[0] if r[:2] == (1, 5))[4] == held > 0


def test_every_batch_of_queries_gets_a_packed_store(spark, monkeypatch):
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]
    docs = spark.createDataFrame([(s, i, " ".join(words[(i * j + s) % 8] for j in range(1, 9))) for s in (1, 2) for i in range(12)], "store_id int, at int, text string")
    memory = index.index_exchanges(docs, ["at"], KeywordExtractor(), HashEmbedder())
    asked = [(s, q, f"{words[q % 8]} {words[(q * 3 + 1) % 8]}") for s in (1, 2) for q in range(10)]
    queries = retrieve.embed_queries(spark.createDataFrame(asked, "store_id int, query_id int, query_text string"), HashEmbedder())
    pick = lambda df: sorted((r.store_id, r.query_id, r.passage_seq, r["rank"], round(r.score, 9)) for r in df.collect())
    want = pick(retrieve.retrieve(memory, queries))
    rows = []

    def counted(df, *rest, real=retrieve.map_groups):
        rows.append(df.count())
        return real(df, *rest)

    monkeypatch.setattr(retrieve, "map_groups", counted)
    few = MemoryConfig(kernel_query_block=2)
    assert pick(retrieve.retrieve(memory, queries, config=few)) == want and want
    seeds = retrieve.recognize(memory, queries, None, few).count()
    # before: the edges and passages of a store for each of its 5 batches
    assert rows[-1] <= 2 * 5 * 3 + 20 + 2 * seeds < 5 * memory.edges.count()


def test_seeds_outside_the_graph_keep_their_mass(spark):
    docs = spark.createDataFrame([(1, i, t) for i, t in enumerate(["alpha bravo charlie", "bravo delta alpha"])], "store_id int, at int, text string")
    memory = index.index_exchanges(docs, ["at"], KeywordExtractor(), HashEmbedder())
    queries = retrieve.embed_queries(spark.createDataFrame([(1, 1, "alpha bravo")], "store_id int, query_id int, query_text string"), HashEmbedder())
    start = spark.createDataFrame([(1, 1, "entity:nowhere", 0.5), (1, 1, "entity:elsewhere", 0.25), (1, 1, "entity:alpha", 0.25)], "store_id int, query_id int, node string, p double")
    pick = lambda df: sorted((r.passage_seq, r["rank"], round(r.score, 12)) for r in df.collect())
    short = MemoryConfig(ppr_max_iter=3)
    assert pick(retrieve._recall_in_tasks(memory, queries, start, None, short)) == pick(retrieve._recall_as_tables(memory, queries, start, None, short))


def test_packed_numbers_are_the_same_numbers():
    rng = np.random.default_rng(2)
    for a in (np.empty(0), np.arange(5, dtype=np.int32), rng.normal(size=100), np.array([np.nan, -0.0, np.inf]), rng.integers(-(2**63), 2**63 - 1, 50), np.arange(20)[::3]):
        b = packing.packed_numbers(packing.pack_numbers(a))
        assert b.dtype == a.dtype and a.tobytes() == b.tobytes()
    assert len(packing.pack_numbers(np.ones(10_000))) < 2_000


def test_extraction_leaves_one_table(spark):
    docs = spark.createDataFrame([(1, i, f"alpha bravo{'x' * i}") for i in range(30)], "store_id int, at int, text string")
    before = folders(spark)
    memory = index.LazyMemory(docs, ["at"], KeywordExtractor(), HashEmbedder(), config=MemoryConfig(ordinal_wide_rows=5))
    assert [r.passage_seq for r in memory.summaries.orderBy("passage_seq").collect()] == list(range(30))
    assert len(folders(spark) - before) == 1  # before: the texts' results up to three times


def test_copies_of_vectors_do_not_grow_with_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    items = spark.createDataFrame([(1, i, i, rng.normal(size=4).tolist()) for i in range(90)], "store_id int, item_id bigint, seq bigint, vec array<double>")
    queries = items.select("store_id", F.col("item_id").alias("query_id"), "vec")
    whole = {(r.query_id, r.item_id): r.score for r in similarity.scaled_scores(queries, items, ["store_id"]).collect()}
    rows = []

    def counted(df, *rest, real=similarity.map_groups):
        rows.append(df.count())
        return real(df, *rest)

    monkeypatch.setattr(similarity, "map_groups", counted)
    small = MemoryConfig(query_block=4, item_block=9)
    got = {(r.query_id, r.item_id): r.score for r in similarity.scaled_scores(queries, items, ["store_id"], small).collect()}
    assert got.keys() == whole.keys() and len(got) == 8100 and all(abs(got[k] - whole[k]) < 1e-12 for k in got)
    assert rows == [90 * 5] * 2  # before: 90 * (23 + 10), and 90 * (23 + 8) for the extremes
