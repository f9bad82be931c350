"""Plans and results of steps that once grew faster than their input."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramspark.config import DEFAULT, MemoryConfig
from engramspark.functions.vector import min_max_normalize
from engramspark.operators import graph, lifetimes, pagerank, similarity, tags
from engramspark.operators.similarity import scaled_scores, score_blocks
from engramspark.catalog import queries
from engramspark.operators.groups import ordinals
from engramspark.plans import index, retrieve
from engramspark.sources import json_array, progress
from engramspark.sources.providers import HashEmbedder, KeywordExtractor


@pytest.mark.parametrize("chars,size", [(10**6, 3), (0, 1), (0, 3), (0, 4)])
def test_chunked_streams_broadcast_nothing_per_stream(spark, chars, size, monkeypatch):
    monkeypatch.setattr(progress, "JOINED_CHARS", chars)
    monkeypatch.setattr(progress, "DEFAULT", DEFAULT.override(fold_block=2))
    text = 'x\n\ndata: {"type":"turn","globalTurnsDone":1}\n\n\n\ndata: {"type":"done"}\n\n\n\n\ndata: {"type":"tail"}'
    streams = spark.range(20).select(F.col("id").alias("stream_id"), F.lit(text).alias("text"))
    at = F.explode(F.sequence(F.lit(0), F.lit((len(text) - 1) // size))).alias("chunk_no")
    chunks = streams.select("stream_id", "text", at).select("stream_id", "chunk_no", F.substring("text", F.col("chunk_no") * size + 1, F.lit(size)).alias("text"))
    got = progress.parse_frames(chunks).select("stream_id", "frame", "event.type")
    want = progress.parse_frames(streams).select("stream_id", "frame", "event.type")
    rows = got.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want.collect())) and len(rows) == 40
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_scaled_scores_shuffle_no_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 2, i, i, None if i == 7 else [] if i == 8 else rng.normal(size=4).tolist()) for i in range(60)]
    items = spark.createDataFrame(rows, "store_id int, item_id bigint, seq bigint, vec array<double>")
    queries = items.select("store_id", F.col("item_id").alias("query_id"), "vec")
    config = MemoryConfig(query_block=4, item_block=9)
    out = scaled_scores(queries, items, ["store_id"], config)
    raw = score_blocks(queries, items, ["store_id"], None, config).select("store_id", "query_id", "item_id", "score")
    want = {(r.query_id, r.item_id): r.s for r in min_max_normalize(raw, ["store_id", "query_id"], "score", "s").collect()}
    got = {(r.query_id, r.item_id): r.score for r in out.collect()}
    assert got.keys() == want.keys() and len(got) == 29 * 30 + 30 * 30
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]  # nothing moves once the pairs are made


def test_copies_of_vectors_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ITEM_BLOCKS", 2, raising=False)
    monkeypatch.setattr(similarity, "KNN_BLOCKS", 3, raising=False)
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(1, i, i, rng.normal(size=4).tolist()) for i in range(120)], "store_id int, item_id bigint, seq bigint, vec array<double>")
    queries = items.select("store_id", F.col("item_id").alias("query_id"), "vec")
    config = MemoryConfig(query_block=4, item_block=9, knn_block=8)
    assert score_blocks(queries, items, ["store_id"], 1, config).count() <= 2 * 120  # one winner per block of items
    base = items.select("store_id", "item_id", "seq", "vec")
    assert similarity._block_pairs(base, ["store_id"], -1.0, config).count() <= 120 * 12  # before: a copy for each of 15 blocks or more
    whole = MemoryConfig(knn_block=1000)
    few, one = (sorted((r.query_id, r["rank"], r.item_id) for r in similarity.knn_join(items, ["store_id"], 0.1, 5, c).collect()) for c in (config, whole))
    assert few == one


def test_positions_of_wide_rows_and_null_groups_need_no_window_of_a_group(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(None if i % 3 == 0 else "a", i) for i in range(30)], "store_id string, n int")
    got = ordinals(rows, ["store_id"], ["n"], "pos", limit=5).collect()
    want = {n: i for key in (0, 1) for i, n in enumerate(n for n in range(30) if (n % 3 == 0) == (key == 0))}
    assert {r.n: r.pos for r in got} == want
    monkeypatch.setattr(json_array, "DEFAULT", DEFAULT.override(ordinal_wide_rows=1), raising=False)
    (tmp_path / "a.json").write_text("[" + ",".join(f'{{"k":{i}}}' for i in range(9)) + "]")
    out = json_array.array_elements(spark, str(tmp_path / "a.json"))
    assert [r.json for r in out.orderBy("pos").collect()] == [f'{{"k":{i}}}' for i in range(9)]
    assert "row_number" not in out._jdf.queryExecution().toString()


def test_summaries_need_no_embedding(spark):
    class Refusing:
        def column(self, text, input_type="document"):
            raise AssertionError("embedded")

    docs = spark.createDataFrame([(1, 0, "alpha beta gamma delta"), (1, 1, "beta omega")], "store_id int, at int, text string")
    memory = index.LazyMemory(docs, ["at"], KeywordExtractor(), Refusing())
    assert [r.passage_seq for r in memory.summaries.orderBy("passage_seq").collect()] == [0, 1]
    with pytest.raises(AssertionError):
        memory.passages


def test_passage_ids_move_no_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 5000, "en")], "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert len(queries._document_heads(spark, str(tmp_path)).first()["text"]) == 50


def test_rank_steps_hold_blocks_and_not_a_row_per_node_and_query(spark, monkeypatch):
    rng = np.random.default_rng(7)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, size=(120, 2)) if a != b})
    edges = spark.createDataFrame([(1, f"n{a}", f"n{b}", 1.0) for x, y in pairs for a, b in ((x, y), (y, x))], "store_id int, src string, dst string, w double")
    seeds = spark.createDataFrame([(1, q, f"n{q % 40}", 1.0) for q in range(60)], "store_id int, query_id int, node string, p double")
    rows = []

    def counted(df, real=pagerank.materialize):
        out = real(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(pagerank, "materialize", counted)
    small = MemoryConfig(ppr_block_edges=100, ppr_cells=50, heavy_node_edges=30)
    got = {(r.query_id, r.node): r.score for r in pagerank.personalized_pagerank(edges, seeds, None, small, "loop").collect()}
    want = {(r.query_id, r.node): r.score for r in pagerank.personalized_pagerank(edges, seeds, None, small, "kernel").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert len(got) > 2000 and max(rows) < 1500  # before: nodes times queries


def test_pairs_of_facts_are_counted_once_for_both_directions(spark):
    rows = [(1, "a", "b"), (1, "b", "a"), (1, "c", "c"), (1, None, "x"), (1, "x", None), (2, "a", "b")]
    triples = spark.createDataFrame(rows, "store_id int, subject string, object string").withColumn("predicate", F.lit("p"))
    got = sorted(map(tuple, graph.fact_edges(triples).collect()), key=str)
    e = lambda x: None if x is None else f"entity:{x}"
    want = [(1, "a", "b", 2.0), (1, "b", "a", 2.0), (1, "c", "c", 2.0), (1, None, "x", 2.0), (1, "x", None, 2.0), (2, "a", "b", 1.0), (2, "b", "a", 1.0)]
    assert got == sorted([(s, e(a), e(b), w) for s, a, b, w in want], key=str)


def test_few_queries_search_many_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ITEM_BLOCKS", 2)
    rng = np.random.default_rng(9)
    items = spark.createDataFrame([(1, i, i, rng.normal(size=4).tolist()) for i in range(60)], "store_id int, item_id bigint, seq bigint, vec array<double>")
    queries = items.where("item_id < 2").select("store_id", F.col("item_id").alias("query_id"), "vec")
    local = score_blocks(queries, items, ["store_id"], 1, MemoryConfig(item_block=5))
    assert 2 * 6 < local.count() <= 2 * 12  # a winner per query and block; before: two blocks
    best = similarity.top_k(queries, items, ["store_id"], 1, MemoryConfig(item_block=5)).collect()
    assert sorted((r.query_id, r.item_id) for r in best) == [(0, 0), (1, 1)]


def test_stores_of_many_edges_are_recalled_in_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, i, t) for i, t in enumerate(["alpha bravo charlie", "bravo delta alpha", "echo foxtrot delta"])], "store_id int, at int, text string")
    memory = index.index_exchanges(docs, ["at"], KeywordExtractor(), HashEmbedder())
    queries = retrieve.embed_queries(spark.createDataFrame([(1, 1, "alpha bravo")], "store_id int, query_id int, query_text string"), HashEmbedder())
    pick = lambda df: {(r.passage_seq, r["rank"], round(r.score, 9)) for r in df.collect()}
    want = pick(retrieve.retrieve(memory, queries, method="loop"))
    kinds = []

    def shown(df, *rest, real=retrieve.map_groups):
        kinds.append({f.name: f.dataType.simpleString() for f in df.schema})
        return real(df, *rest)

    monkeypatch.setattr(retrieve, "map_groups", shown)
    assert pick(retrieve.retrieve(memory, queries)) == want and want
    assert kinds[0]["a"] == kinds[0]["b"] == "bigint" and DEFAULT.kernel_max_edges > 2_000_000


def test_only_wanted_neighbours_get_windows():
    rng = np.random.default_rng(4)
    since = rng.integers(0, 50, 40)
    until = np.where(rng.random(40) < 0.3, lifetimes.FAR, since + rng.integers(0, 30, 40))
    wanted, own = until == lifetimes.FAR, 20
    every = lifetimes.write_windows(since, until, own, 3)
    assert lifetimes.write_windows(since, until, own, 3, wanted) == [w for w, x in zip(every, wanted, strict=True) if x]
    late = until >= own  # earlier lives compete with nothing
    assert lifetimes.write_windows(since[late], until[late], own, 3, wanted[late]) == [w for w, x in zip(every, wanted, strict=True) if x]


def test_filters_are_matched_inside_the_rows_of_passages(spark):
    passages = spark.createDataFrame(
        [(1, 0, ["plan"], ["large-ring", "ring"]), (1, 1, ["event", "plan"], ["large"]), (1, 2, None, ["ringing"]), (1, 3, ["event"], None)],
        "store_id int, passage_seq bigint, types array<string>, topics array<string>",
    )
    filters = spark.createDataFrame(
        [(1, 1, ["plan"], ["large ring", "ring"]), (1, 2, None, ["ring large"]), (1, 3, ["event", "event", None], []), (1, 4, [], None), (1, 5, ["goal"], ["ring"])],
        "store_id int, query_id int, type_filter array<string>, topic_filter array<string>",
    )
    out = tags.matching_passages(passages, filters)
    assert sorted((r.query_id, r.passage_seq) for r in out.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 1), (3, 3)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashAggregate" not in plan and "hashpartitioning" not in plan


def test_words_are_found_by_a_table_of_letters():
    from engramspark.sources import providers

    word = KeywordExtractor.WORD
    find = providers.word_finder(word, KeywordExtractor.LETTER, KeywordExtractor.LEAST)
    every = "".join(map(chr, range(0x110000)))
    rng = np.random.default_rng(6)
    texts = ["", "plain words_and 1234 abcd5efgh", "größe été ²³¼½ ⅣⅤⅥⅦ 漢字漢字 \ud800abcd", every[:0x10000], every, "abcd𐐀𐐁𐐂𐐃 wxyz"]
    texts += ["".join(chr(c) for c in rng.choice([32, 45, 95, 97, 122, 0xE9, 0x661, 0x4E00, 0xAA, 0x2160], 300)) for _ in range(50)]
    assert word == r"[^\W\d_]{4,}" and all(find(t) == re.findall(word, t) for t in texts)
