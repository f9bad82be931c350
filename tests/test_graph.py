import numpy as np
from pyspark.sql import functions as F

from engramspark.config import MemoryConfig
from engramspark.operators import graph, ingest
from engramspark.operators.groups import ordinals


def triples(spark, rows):
    return spark.createDataFrame(
        rows, "store_id int, passage_seq bigint, ord int, subject string, predicate string, object string"
    )


def edge_map(df):
    return {(r.src.split(":")[1], r.dst.split(":")[1]): r.w for r in df.collect()}


def test_fact_edges_accumulate_and_self_loops_double(spark):
    t = triples(spark, [(1, 0, 0, "a", "p", "b"), (1, 1, 0, "b", "q", "a"), (1, 1, 1, "c", "is", "c")])
    assert edge_map(graph.fact_edges(t)) == {("a", "b"): 2.0, ("b", "a"): 2.0, ("c", "c"): 2.0}


def test_first_occurrence_owns_a_fact_whatever_its_split(spark):
    t = triples(spark, [(1, 3, 0, "a b", "c", "d"), (1, 1, 1, "a", "b c", "d"), (1, 1, 0, "x", "y", "z")])
    facts = {r.fact: r for r in ingest.build_facts(t).collect()}
    assert len(facts) == 2
    assert (facts["a b c d"].subject, facts["a b c d"].owner_seq) == ("a", 1)


def test_only_new_rows_keep_the_first(spark):
    have = spark.createDataFrame([(1, "x")], "store_id int, fact string")
    batch = spark.createDataFrame([(1, "x", 0, "o1"), (1, "y", 2, "o2"), (1, "y", 1, "o3")], "store_id int, fact string, seq int, o string")
    assert [(r.fact, r.o) for r in ingest.only_new(batch, have, "fact").collect()] == [("y", "o3")]


def test_remove_nodes_drops_incident_edges(spark):
    t = triples(spark, [(1, 0, 0, "a", "p", "b"), (1, 0, 1, "b", "p", "c")])
    gone = spark.createDataFrame([(1, "entity:c")], "store_id int, node string")
    assert set(edge_map(graph.remove_nodes(graph.fact_edges(t), gone))) == {("a", "b"), ("b", "a")}


def replay_edges(passages, vecs, threshold, k):
    """Plain sequential indexing of one store."""
    order, weights = [], {}
    for triples_ in passages:
        fresh = False
        for s, o in triples_:
            for e in (s, o):
                if e not in order:
                    order.append(e)
                    fresh = True
        for s, o in triples_:
            for cell in ((s, o), (o, s)):
                weights[cell] = weights.get(cell, 0) + 1
        if fresh:
            for q in order:
                sims = []
                for c in order:
                    if c != q:
                        sim = float(vecs[q] @ vecs[c] / (np.linalg.norm(vecs[q]) * np.linalg.norm(vecs[c])))
                        if sim >= threshold:
                            sims.append((c, sim))
                sims.sort(key=lambda p: -p[1])
                if len(q) > 2:
                    for c, sim in sims[:k]:
                        weights[(q, c)] = weights[(c, q)] = sim
    return weights


def test_edge_ledger_equals_sequential_indexing(spark):
    rng = np.random.default_rng(11)
    rows, vec_rows, want = [], [], {}
    names = [f"ent{i}" for i in range(7)] + ["zz"]
    for store in range(12):
        vecs = {n: rng.normal(size=3) for n in names}
        passages = [
            [tuple(rng.choice(names, 2)) for _ in range(rng.integers(1, 3))] for _ in range(8)
        ]
        for p, ts in enumerate(passages):
            rows += [(store, p, i, str(s), "r", str(o)) for i, (s, o) in enumerate(ts)]
        vec_rows += [(store, n, [float(x) for x in v]) for n, v in vecs.items()]
        for cell, w in replay_edges(passages, vecs, 0.3, 2).items():
            want[(store, str(cell[0]), str(cell[1]))] = w
    t = triples(spark, rows)
    vec = spark.createDataFrame(vec_rows, "store_id int, entity string, vec array<double>")
    entities = ingest.build_entities(t).join(vec, ["store_id", "entity"])
    for block in (2048, 3):
        config = MemoryConfig(synonymy_threshold=0.3, synonymy_top_k=2, knn_block=block)
        edges = graph.ledger_edges(t, graph.synonym_writes(entities, config))
        got = {(r.store_id, r.src.split(":")[1], r.dst.split(":")[1]): r.w for r in edges.collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_ordinals_of_a_large_group_match_the_window(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), F.col("id"), F.xxhash64("id").alias("o")
    )
    a = ordinals(df, ["k"], ["o", "id"], "n").orderBy("id").collect()
    b = ordinals(df, ["k"], ["o", "id"], "n", limit=50).orderBy("id").select("k", "id", "o", "n").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
