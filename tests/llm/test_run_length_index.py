"""Repeat removal against counting of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from engramspark.llm.run_length_index import RunLengthIndex, long_repeats, merged, remove_repeats, repeated_windows, without


def brute(texts, length, with_text=False):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        spans = merged([(i, i + length) for i in range(len(d) - length + 1) if n[d[i : i + length]] > 1])
        kept = without(d, spans)
        out.append((len(d), len(d) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
    return out if with_text else [r[:4] for r in out]


def test_statistics_from_run_ends():
    r = random.Random(1)
    for _ in range(200):
        strings = [bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 6))]
        if r.random() < 0.5:
            strings.append(strings[0][1:] + b"a")
        index = RunLengthIndex(strings)
        for s, start in zip(strings, index.starts, strict=True):
            got = index.matching_statistics(int(start), len(s))
            for i in range(len(s)):
                best = max(
                    (k for t, o in zip(strings, index.starts, strict=True) for j in range(len(t)) if (o, j) != (start, i)
                     for k in [next((k for k in range(min(len(s) - i, len(t) - j)) if s[i + k] != t[j + k]), min(len(s) - i, len(t) - j))]),
                    default=0,
                )
                assert got[i] == best
        assert int(index.lengths.sum()) == index.size and len(index.symbols) <= index.size


def sample(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(1, 9)))
    passages = ["".join(word() for _ in range(r.randint(3, 30))) for _ in range(6)]
    texts = [None, "", "ab", "a" * 100, "xyzw" * 50]
    for _ in range(60):
        parts = [r.choice(passages) if r.random() < 0.4 else word() for _ in range(r.randint(1, 12))]
        texts.append("".join(parts))
    for _ in range(12):
        copy = list(r.choice(texts[5:]))
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(len(copy))] = "#"
        texts.append("".join(copy))
    return texts


def test_index_of_millions_of_symbols():
    """One passage, whole or in part, in thousands of surroundings: ranks pass 21 bits long before they are all different."""
    r, length = np.random.default_rng(5), 120
    draw = lambda n: r.integers(97, 123, n).astype(np.uint8).tobytes()
    passage, strings = draw(200), []
    for _ in range(3900):
        a, z = sorted(r.integers(0, 201, 2)) if r.random() < 0.5 else (0, 200)
        strings.append(draw(int(r.integers(250, 350))) + passage[a:z] + draw(int(r.integers(250, 350))))
    assert sum(map(len, strings)) > 2_800_000
    codes = np.array([hash(s[i : i + length]) for s in strings for i in range(len(s) - length + 1)])
    _, place, times = np.unique(codes, return_inverse=True, return_counts=True)
    hit, at, want = times[place] > 1, 0, []
    for i, s in enumerate(strings):
        n = len(s) - length + 1
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[at : at + n], [0]])))
        want += [(i, a, b - 1 + length) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        at += n
    assert list(repeated_windows(strings, [True] * len(strings), length)) == want


@pytest.mark.parametrize(("seed", "hot", "chunk"), [(1, 4000, 1 << 20), (2, 2, 1 << 20), (3, 1, 100), (4, 4000, 50)])
def test_small_windows(spark, seed, hot, chunk):
    texts = sample(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, seed string, h int").repartition(5)
    rows = long_repeats(docs, length=20, gram=6, hot=hot, chunk=chunk, with_text=True).orderBy("doc_id").collect()
    want = brute(texts, 20, with_text=True)
    assert [tuple(r)[1:] for r in rows] == want


def test_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    rows = long_repeats(docs).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute(texts, 400)


def test_edges(spark):
    long = "".join(chr(97 + (i * i * 7 + i // 13) % 26) for i in range(30_000))
    data = [(1, "same text " * 60), (1, "same text " * 60), (None, long), (None, long[::-1]), (2, long[5000:5399]), (3, long[9000:9400])]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in data], "doc_id bigint, text string, data binary")
    got = sorted(tuple(r)[1:] for r in long_repeats(docs).collect())
    assert got == sorted(brute([t for _, t in data], 400))
    assert long_repeats(docs.limit(0)).count() == 0
    left = remove_repeats(docs)
    assert left.columns == docs.columns
    want = [x[4] for x in brute([t for _, t in data], 400, with_text=True) if x[4]]
    assert sorted(r.text for r in left.collect()) == sorted(want)
