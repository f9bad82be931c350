"""Winnowing against a plain version, and its match guarantee."""

import hashlib
import random

import numpy as np

from engramspark.llm.winnowing import as_set, compare_neighbours, edited, fingerprint, fingerprints, gram_hashes, winnow


def plain_winnow(hashes, w):
    w, chosen = min(w, len(hashes)), []
    for i in range(len(hashes) - w + 1):
        at = max(range(i, i + w), key=lambda j: (-int(hashes[j]), j))
        if at not in chosen:
            chosen.append(at)
    return sorted(chosen)


def test_windows_against_plain_version():
    r = np.random.default_rng(2)
    for _ in range(300):
        hashes = r.integers(0, r.integers(1, 12), r.integers(1, 60)).astype(np.uint64)
        for w in (1, 2, 3, 7, 8, 100):
            assert winnow(hashes, w)[1].tolist() == plain_winnow(hashes, w)


def test_rolling_hash_depends_on_the_gram_alone():
    r = random.Random(4)
    codes = np.array([r.randrange(4) for _ in range(700_000)], dtype=np.uint32)
    hashes, seen = gram_hashes(codes, 9), {}
    for i in [*range(2000), *range(260_000, 265_000), *range(len(codes) - 2000, len(codes) - 8)]:
        assert seen.setdefault(codes[i : i + 9].tobytes(), hashes[i]) == hashes[i]
    assert len(set(seen.values())) == len(seen)


def test_shared_passage_shares_a_hash():
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    for _ in range(50):
        passage = word(123)
        a, b = (set(fingerprint(word(r.randrange(500)) + passage + word(r.randrange(500)), 24, 100)[0]) for _ in "ab")
        assert a & b


def brute(texts):
    sets = [set(as_set(fingerprint(t, 24, 100)[0]).tolist()) for t in texts]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = []
    for i, t in enumerate(texts):
        j = (i + 1) % len(texts)
        new = edited(t, texts[j])
        e = set(as_set(fingerprint(new, 24, 100)[0]).tolist())
        hexes = ["".join(f"{h:08x}" for h in sorted(s)) for s in (sets[i], e)]
        out.append((len(t), hashlib.sha256(new.encode()).hexdigest(), *hexes, like(sets[i], e), like(sets[i], sets[j])))
    return out


def test_neighbours_of_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    rows = compare_neighbours(docs.repartition(5)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute(texts)


def test_edges(spark):
    texts = [None, "", "short", "a b c " * 400, "a b c " * 400, "é" * 30_000, "x", "end"]
    docs = spark.createDataFrame([(i * 7, t, "n", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars string, h int")
    rows = compare_neighbours(docs.repartition(6)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute([t or "" for t in texts])
    assert rows[3].fingerprint == rows[4].fingerprint and rows[3].near_next == 1.0
    assert compare_neighbours(docs.limit(0)).count() == 0
    one = compare_neighbours(docs.where("doc_id = 14")).collect()
    assert len(one) == 1 and one[0].near_next == one[0].near_edited == 1.0 or one[0].near_next == 1.0
    twice = docs.where("doc_id = 21").union(docs.where("doc_id = 21")).union(docs.selectExpr("null", "text", "n_chars", "h"))
    assert compare_neighbours(twice).count() == 2 + len(texts)
    positions = fingerprints(docs).where("doc_id = 21").first()
    assert positions.positions == sorted(positions.positions) and len(positions.hashes) == len(positions.positions) > 0
