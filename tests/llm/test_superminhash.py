"""Near duplicates against all pairs on full shingle sets."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from engramspark.llm.superminhash import SIZE, components, drop_near_duplicates, mix, near_duplicates, signature

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    """rows: (id, text) with distinct ids; exact links through an inverted index."""
    sets = {i: plain_set(t, k) for i, t in rows}
    where, root = defaultdict(list), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sorted(sets.items()):
        common = defaultdict(int)
        for g in s:
            for j in where[g]:
                common[j] += 1
            where[g].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def plain_signature(elements, size):
    """Element by element, with early stopping on the histogram of levels."""
    best = [1 << 63] * size
    for e in elements:
        perm = list(range(size))
        for j in range(size):
            x = int(mix(np.array([e + (j + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1], dtype=np.uint64))[0])
            k = j + ((x >> 32) * (size - j) >> 32)
            perm[j], perm[k] = perm[k], perm[j]
            best[perm[j]] = min(best[perm[j]], j << 32 | x & 0xFFFFFFFF)
    return best


@pytest.mark.parametrize("n", [1, 2, 7, 40, 2000])
def test_signature_is_order_free_and_stops_without_loss(n):
    r = random.Random(n)
    elements = [r.getrandbits(64) for _ in range(n)]
    for size in (SIZE, 16) if n < 100 else (16,):
        assert signature(np.array(elements, dtype=np.uint64), size).tolist() == plain_signature(elements, size)


def check(rows, docs, **options):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, **options).collect()}
    assert got == brute(rows, options["k"], options["percent"])


@pytest.mark.parametrize("block", [4096, 3])
def test_every_document(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    if block == 3:  # every larger cluster goes through pairs of blocks
        rows = rows[:250]
        docs = docs.where(f"doc_id in ({','.join(str(i) for i, _ in rows)})")
    check(rows, docs, k=4, percent=80, block=block)


def test_edges(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(3000)}" for _ in range(400)]
    chain = []
    for step in range(12):  # neighbours are linked, the ends are not
        chain.append(" ".join(base[step * 12 : step * 12 + 250]))
    texts = [None, "", " \n", "one", "one", "ONE", "one two", "a b c d", "A b C d", *chain, " ".join(base * 80), "é È ß ẞ", "é è ß ẞ"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id bigint, text string, node string, h int")
    check(rows, docs, k=4, percent=80)
    check(rows, docs, k=5, percent=80, block=2)
    assert near_duplicates(docs.limit(0)).count() == 0
    twice = docs.union(docs.where("doc_id = 9")).union(docs.selectExpr("CAST(null AS bigint)", "text", "node", "h"))
    got = near_duplicates(twice, k=4).collect()
    assert len(got) == 2 * len(rows) + 1
    assert all(not x.kept or x.n_shingles == 0 for x in got if x.doc_id is None)
    left = drop_near_duplicates(twice, k=4)
    assert left.columns == docs.columns
    first = {i for i, (_, _, kept) in brute(rows, 4, 80).items() if kept}
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(first)
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(6)
    chain = [(i, i + 1) for i in range(1000, 1300)]
    star = [(5, 2000 + i) for i in range(300)]
    loose = [(r.randrange(3000, 3400), r.randrange(3000, 3400)) for _ in range(220)]
    edges = [(b, a) if r.random() < 0.5 else (a, b) for a, b in chain + star + loose]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
