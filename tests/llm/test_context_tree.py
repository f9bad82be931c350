"""Context-tree weighting against a recursive version."""

import math
import zlib
from collections import Counter
from functools import cache

import pytest
from pyspark.sql import functions as F

from engramspark.llm.context_tree import Dealing, score


def brute(rows, depth, held):
    """rows: (id, text). Plain recursion over the context tree."""
    train = [(t or "").encode() for i, t in rows if not held(i)]
    counts = Counter()
    children = {}
    for data in train:
        full = bytes([0xFE]) * depth + data + b"\xff"
        for i in range(depth, len(full)):
            byte = full[i]
            for d in range(depth + 1):
                context = full[i - d : i]
                if d:
                    children.setdefault(context[1:], set()).add(context)
                for k in range(8):
                    counts[context, (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1] += 1

    @cache
    def pe(context, node):
        a, b = counts[context, node, 0], counts[context, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @cache
    def below(context, node):
        return sum(pw(c, node) for c in children.get(context, ()))

    @cache
    def pw(context, node):
        if len(context) == depth:
            return pe(context, node)
        a, b = pe(context, node), below(context, node)
        return max(a, b) + math.log1p(math.exp(-abs(a - b))) - math.log(2)

    def one(full, i, node, d=0):
        context = full[i - d : i]
        a, b = counts[context, node, 0], counts[context, node, 1]
        kt = (b + 0.5) / (a + b + 1)
        if d == depth:
            return kt
        longer = full[i - d - 1 : i]
        if not counts[longer, node, 0] + counts[longer, node, 1]:
            return kt
        stop = 1 / (1 + math.exp(min(700, below(context, node) - pe(context, node))))
        return stop * kt + (1 - stop) * one(full, i, node, d + 1)

    words = Counter(w for t in train for w in [*t.lower().split(), b""])
    total, distinct = sum(words.values()), len(words)
    out = {}
    for i, text in rows:
        data = (text or "").encode()
        full = bytes([0xFE]) * depth + data + b"\xff"
        logs = 0.0
        for at in range(depth, len(full)):
            for k in range(8):
                p = one(full, at, (1 << k) | (full[at] >> (8 - k)))
                logs += math.log10(p if full[at] >> (7 - k) & 1 else 1 - p)
        ws = [*data.lower().split(), b""]
        base = sum(math.log10((words[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        out[i] = (held(i), len(ws), sum(words[w] > 0 for w in ws), total, base, logs)
    return out


def crc(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0


@pytest.mark.parametrize(("depth", "chunk", "dealing"), [(2, 300, Dealing()), (5, 200, Dealing(share=7, fan=2, salt=2)), (4, 1 << 20, Dealing(share=20))])
def test_against_recursion(spark, depth, chunk, dealing):
    rows = [(i, t) for i, t in enumerate([
        None, "", "a", "the cat sat on the mat", "the cat sat on the hat", "The  Cat\nsat", "été à la plage", "zzzzzzzz", "the cat sat on the mat", "\0 x", "the cat sat on a long mat " * 90,
        "on the mat the cat sat", "qqq unseen wörds", *(f"number {i % 3} of the list" for i in range(30)),
    ])]
    assert any(crc(i) for i, _ in rows)
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id bigint, text string, data string, n int").repartition(3)
    got = {r.doc_id: tuple(r)[1:7] for r in score(docs, held(), depth=depth, chunk=chunk, dealing=dealing).collect()}
    want = brute(rows, depth, crc)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4]
        assert got[i][4:] == pytest.approx(want[i][4:], rel=1e-6, abs=1e-6)


def test_probabilities_of_all_next_bytes_sum_to_one(spark):
    """All one-byte texts and longer ones share the probability 1; texts of one ASCII byte and the empty one stay below."""
    rows = [(i, chr(i)) for i in range(128)] + [(200, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    total = sum(10**r.score for r in score(docs, F.lit(False), depth=3).collect())
    assert 0.5 < total <= 1


def test_documents_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = score(docs, held()).collect()
    assert len(rows) == 1000
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert score(docs.limit(0), held()).count() == 0
    odd = docs.limit(3).union(docs.limit(3)).selectExpr("IF(doc_id = 1, null, doc_id) AS doc_id", "text")
    assert score(odd, held()).count() == 6
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in score(docs.limit(3), F.lit(True)).collect())
