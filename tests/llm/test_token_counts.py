"""Token counts against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from engramspark.llm.token_counts import count_tokens, counter

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_random_strings(library):
    mine = counter(public_tokenizers.path(NAME))
    r = random.Random(3)
    alphabet = [*"ab  \n\t'sé1²½٣_-.<|>中 \x1c\xa0　À", "<|endoftext|>", "'ll", "  ", " the", "tion", ".,"]
    for _ in range(5000):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))
        assert mine.count(s) == expected(library, s), repr(s)


def test_every_document(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = count_tokens(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.n_bytes) == (expected(library, texts[r.doc_id]), len(texts[r.doc_id].encode()))


def test_edges(spark, library):
    long = "ab" * 40_000 + " " + "word, " * 30_000
    data = [(1, None, "x", 7), (2, "", "x", 7), (3, "same text", "x", 7), (3, "same text", "x", 7), (None, long, None, 7)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, n_tokens string, id int")
    rows = count_tokens(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.over_limit) for r in rows) == sorted(
        (d[0] or 0, n := expected(library, d[1]), n > 1024) for d in data
    )
    assert count_tokens(docs.limit(0)).count() == 0
