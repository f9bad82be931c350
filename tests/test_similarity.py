import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from engramspark.config import MemoryConfig
from engramspark.functions.vector import cosine, min_max_normalize
from engramspark.operators.similarity import _ever_best_ranked, close_pairs, cosine_slices, ever_best, knn_join, top_k

SMALL = MemoryConfig(query_block=3, item_block=7, knn_block=16)


def clustered(n, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    return centers[rng.integers(0, 6, n)] + 0.35 * rng.normal(size=(n, dim))


def items(spark, vecs, store=0):
    rows = [(store, i, i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "store_id int, item_id bigint, seq bigint, vec array<double>")


def cos(vecs):
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    return u @ u.T


def test_top_k_in_blocks_equals_brute_force(spark):
    vecs = clustered(60)
    it = items(spark, vecs).unionByName(items(spark, clustered(20, seed=1), store=1))
    q = it.where("item_id % 5 = 0").select("store_id", F.col("item_id").alias("query_id"), "vec")
    got = {(r.query_id, r["rank"]): r.item_id for r in top_k(q, it, ["store_id"], 4, SMALL).where("store_id = 0").collect()}
    c = cos(vecs)
    want = {(i, r + 1): j for i in range(0, 60, 5) for r, j in enumerate(np.argsort(-c[i], kind="stable")[:4])}
    assert got == want


def test_ties_keep_stored_order(spark):
    it = items(spark, [[1.0, 0.0]] * 9)
    q = it.where("item_id = 0").select("store_id", F.col("item_id").alias("query_id"), "vec")
    rows = top_k(q, it, ["store_id"], 5, SMALL).orderBy("rank").collect()
    assert [r.item_id for r in rows] == [0, 1, 2, 3, 4]


def test_odd_vectors_score_zero_and_missing_are_skipped(spark):
    it = spark.createDataFrame(
        [(0, 1, 1, [0.0, 0.0]), (0, 2, 2, [1.0]), (0, 3, 3, None), (0, 4, 4, [2.0, 0.0])],
        "store_id int, item_id bigint, seq bigint, vec array<double>",
    )
    q = spark.createDataFrame([(0, 9, [1.0, 0.0])], "store_id int, query_id bigint, vec array<double>")
    rows = top_k(q, it, ["store_id"], 5).orderBy("rank").collect()
    assert [(r.item_id, r.score) for r in rows] == [(4, 1.0), (1, 0.0), (2, 0.0)]


def test_knn_join_pruned_blocks_are_exact(spark):
    for seed in (2, 3):
        vecs = clustered(150, seed=seed)
        it = items(spark, vecs).unionByName(items(spark, clustered(10, seed=9), store=1))
        c = cos(vecs)
        np.fill_diagonal(c, -2)
        got = {(r.query_id, r.item_id) for r in knn_join(it, ["store_id"], 0.8, None, SMALL).where("store_id = 0").collect()}
        assert got == {(i, j) for i, j in zip(*np.where(c >= 0.8))}
        top = knn_join(it, ["store_id"], 0.8, 3, SMALL).where("store_id = 0").collect()
        want = {(i, j) for i in range(150) for j in np.argsort(-c[i], kind="stable")[:3] if c[i, j] >= 0.8}
        assert {(r.query_id, r.item_id) for r in top} == want


def test_ever_best_equals_a_replay():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, k = 12, int(rng.integers(1, 4))
        scores, born, seq = rng.integers(0, 5, n) / 5, rng.integers(0, 8, n), np.arange(n)
        since = int(rng.integers(0, 8))
        want = set()
        for t in range(since, 9):
            alive = [i for i in range(n) if born[i] <= t]
            want |= set(sorted(alive, key=lambda i: (-scores[i], seq[i]))[:k])
        assert want <= set(ever_best(scores, seq, born, since, k).tolist()) and \
            set(ever_best(scores, seq, born, since, k).tolist()) == want


def test_cosine_column(spark):
    rows = [([1.0, 2.0], [2.0, 4.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), ([], [])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 1) < 1e-12 and got[1:] == [0.0, 0.0, 0.0]


def test_min_max_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("b", 1.0), ("b", 5.0), ("b", 2.0)], "q string, v double")
    got = sorted((r.q, r.s) for r in min_max_normalize(df, ["q"], "v", "s").collect())
    assert got == [("a", 0.0), ("a", 0.0), ("b", 0.0), ("b", 0.25), ("b", 1.0)]


def test_close_pairs_are_those_of_all_scores():
    rng = np.random.default_rng(8)
    vecs = [rng.integers(-2, 3, 4 if i % 3 else 9).astype(float).tolist() for i in range(150)]
    vecs += [[], [0.0] * 4, [1.0, 0.0, 0.0, 0.0], [1.0, 1.0, 1.0, 1.0], [1e-300] * 4, [3e200, 0.0, 0.0, 0.0]]
    a = pa.chunked_array([pa.array(vecs[:70], pa.list_(pa.float64())), pa.array(vecs[70:], pa.list_(pa.float64()))])
    b = a.slice(20)
    for threshold in (-0.5, 0.0, 0.5, 0.8, 1.0):
        for cells in (400, 10**6):
            want = {(at + int(i), int(j)): s[i, j] for at, s in cosine_slices(a, b, cells) for i, j in zip(*np.nonzero(s >= threshold), strict=True)}
            rows = [(at + int(i), int(j), x) for at, n, r, c, s in close_pairs(a, b, threshold, cells) for i, j, x in zip(r, c, s, strict=True)]
            assert [x[0] for x in rows] == sorted(x[0] for x in rows)
            got = {(i, j): x for i, j, x in rows}
            close = {k for k in want.keys() ^ got.keys() if abs(want.get(k, got.get(k)) - threshold) > 1e-12}
            assert not close and len(got) == len(rows) and all(abs(got[k] - want[k]) < 1e-12 for k in got.keys() & want.keys())
    half = pa.chunked_array([pa.array([[1.0, 0.0, 0.0, 0.0], [1.0, 1.0, 1.0, 1.0]])])
    assert [s.tolist() for *_, s in close_pairs(half, half, 0.5)] == [[1.0, 0.5, 0.5, 1.0]]  # whole numbers reach the threshold exactly


def test_neighbours_are_looked_at_until_enough_are_there_from_the_start():
    class Counted(list):
        read = 0

        def __getitem__(self, i):
            Counted.read += not isinstance(i, slice)
            return super().__getitem__(i)

    births = Counted([5, 4, 9, 1, 2, *range(100)])
    assert _ever_best_ranked(births, 3, 2) == [0, 1, 3, 4] and Counted.read < 10
