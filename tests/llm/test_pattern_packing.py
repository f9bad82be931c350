"""Packing: exact round trip of ids, gapless offsets, near the lower bound."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from engramspark.llm.pattern_packing import best_fit, fit_counts, pack, patterns, piece_lengths, plan, text_ids

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def test_ids_of_random_strings(library):
    mine, r = text_ids(public_tokenizers.path(NAME)), random.Random(5)
    alphabet = [*"ab  \n\t'sé1²½٣_-.<|>中\u0085\u180e \x1c\x1f\xa0　À\u200b", "<|endoftext|>", "'ll", "  ", " the", "tion", ".,", "x" * 400, "ab" * 600]
    for _ in range(5000):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))
        assert np.frombuffer(mine.ids(s), dtype="<u4").tolist() == library.encode(s, add_special_tokens=False).ids, repr(s)


def check(rows, texts, library, slack):
    """texts: one for each row of the input, by id."""
    total, spans = 0, defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        spans[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        total += len(ids)
        mine = sorted(pieces.pop(doc_id), key=lambda r: r.piece)
        assert [r.length for r in mine] == piece_lengths(len(ids), 1024)
        at = 0
        for k, r in enumerate(mine):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    assert not pieces
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(spans) <= math.ceil(total / 1024) + slack


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, library, slack=2)


def test_edges(spark, library):
    texts = {1: None, 2: "", 3: "a  b \n c ", 4: "word " * 5000, 5: "\n\n x", 6: "<|endoftext|> a", 7: " lead", 8: "ends "}
    docs = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()], "doc_id bigint, text string, length string, id int")
    check(pack(docs).collect(), texts, library, slack=1)
    assert pack(docs.limit(0)).count() == 0
    twice = docs.where("doc_id = 4").union(docs.where("doc_id = 4"))
    rows = pack(twice).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) == 2 * len(piece_lengths(len(library.encode(texts[4]).ids) + 1, 1024))


def test_plan_covers_every_piece():
    r = np.random.default_rng(5)
    for _ in range(30):
        capacity = int(r.integers(2, 60))
        histogram = r.integers(0, 50, capacity + 1) * (r.random(capacity + 1) < 0.6)
        histogram[0] = 0
        p, fill = plan(histogram, capacity), defaultdict(list)
        for length in np.flatnonzero(histogram):
            for n in range(histogram[length]):
                at = np.searchsorted(p["key"], length << 44 | n, side="right") - 1
                k = n - p["first"][at]
                fill[int(p["sequence"][at] + k // p["mult"][at])].append((int(p["offset"][at] + k % p["mult"][at] * length), int(length)))
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity


def test_fit_recovers_counts():
    rows = patterns(np.arange(1, 65), 64)
    truth = np.zeros(len(rows))
    truth[::7] = 5
    histogram = np.bincount(rows.ravel(), weights=np.repeat(truth, 3) * (rows > 0).ravel(), minlength=65)
    x = fit_counts(rows, histogram, steps=3000)
    again = np.bincount(rows.ravel(), weights=np.repeat(x, 3) * (rows > 0).ravel(), minlength=65)
    assert (x >= 0).all() and np.abs(again - histogram)[1:].max() < 0.5


def test_best_fit_keeps_counts():
    left = np.zeros(11, dtype=int)
    left[[7, 3, 5, 2]] = 4, 5, 3, 9
    groups = best_fit(left, 10)
    for length in (7, 3, 5, 2):
        assert sum(c * m for c, content in groups for v, m in content if v == length) == left[length]
    assert all(sum(v * m for v, m in content) <= 10 for _, content in groups)
