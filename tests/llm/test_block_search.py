"""Blocked search against brute force over all documents, with bounds that skip and never lose."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from engramspark.llm.block_search import Best, Queries, impacts, index_chunk, search, search_chunk, terms

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, all_terms = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            s = 0
            for t in plain_terms(text):
                if c[t]:
                    m = 100 - 75 + 75 * c.total() * n_docs // all_terms
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return out


def corpus(r, n, words=400):
    skewed = lambda: f"w{int(words * r.random() ** 3)}"
    texts = [" ".join(skewed() for _ in range(r.randrange(1, 120))) for _ in range(n)]
    return [(i, r.choice(texts[: n // 3]) if r.random() < 0.2 else t) for i, t in enumerate(texts)]


def test_terms():
    r = random.Random(0)
    pieces = ["A", "z", "Ñ", "é", "İ", " ", "\x7f", "_", "-", "0", "日本", "\x00", "'", " ", "ß"]
    for _ in range(2000):
        text = "".join(r.choice(pieces) for _ in range(12))
        assert [t.decode() for t in terms(text)] == plain_terms(text)


def test_blocks_skip_documents_and_lose_none():
    r = random.Random(4)
    docs = corpus(r, 3000, 3000)
    held = [Counter(terms(t)) for _, t in docs]
    df = Counter(t for c in held for t in c)
    items = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(12)) + " w0 w0 w1") for i in range(20)]
    queries = Queries(items, dict(df), len(docs))
    number, total = {t: i for i, t in enumerate(queries.names)}, sum(c.total() for c in held)
    rows = []
    for c in held:
        mine = sorted((number[t], n) for t, n in c.items() if t in number)
        rows.append((np.array([t for t, _ in mine], np.int64), impacts(np.array([n for _, n in mine], np.int64), c.total(), len(docs), total)))
    best, scored = [Best(10) for _ in items], 0
    for at in range(0, len(docs), 512):
        part = [(i, x) for i, x in zip(range(at, min(at + 512, len(docs))), rows[at : at + 512], strict=True) if len(x[0])]
        names = ["docs", "doc_terms", "doc_impacts", "block_term", "block_ends", "block_docs", "max_ends", "max_terms", "max_impacts"]
        chunk = dict(zip(names, index_chunk([x for _, x in part], queries.together), strict=True))
        scored += search_chunk([i for i, _ in part], chunk, queries, best)
    got = [(q, n + 1, x[2], -x[0]) for q, b in enumerate(best) for n, x in enumerate(b.rows)]
    assert got == brute(docs, items)
    matched = sum(bool(c.keys() & set(terms(t))) for c in held for _, t in items)
    assert scored < 0.5 * matched


@pytest.mark.parametrize("batch_bytes", [1 << 24, 200])
def test_whole_query_against_brute_force(spark, batch_bytes):
    r = random.Random(batch_bytes)
    docs = [*corpus(r, 900), (None, "w1 w2"), (901, None), (902, ""), (903, "w3 " * 200_000), (5, "w9 w8 w7"), (5, "w9 w8 w7")]
    items = [(i, " ".join(f"W{r.randrange(450)}" for _ in range(r.randrange(1, 9)))) for i in range(12)] + [(50, None), (51, "..."), (52, "unknown"), (None, "w1"), (2, "w9 w8 w7")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id bigint, text string, score int, rank int")
    q = spark.createDataFrame([(*x, "x") for x in items], "item_id bigint, text string, id string")
    got = search(d, q, batch_bytes=batch_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert search(none, items).count() == 0
    assert search(one, items.limit(0)).count() == 0
    assert [tuple(x)[:3] for x in search(one, items).collect()] == [(1, 1, 1)]
