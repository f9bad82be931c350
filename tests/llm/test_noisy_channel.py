"""Viterbi decoding against full enumeration, restored words, held-out toxicity."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramspark.llm import noisy_channel
from engramspark.llm.noisy_channel import OTHER, SYMBOL, CharModel, decode, fit_logistic, options, restore_text, toxicity, trigram_counts

WORDS = "the idiot is a clown and a loser who was worthless pathetic stupid moron trash scum disgusting people little good tree " * 30


@pytest.fixture(scope="module")
def chars():
    return CharModel(trigram_counts([WORDS]))


def test_trigrams():
    counts = trigram_counts(["ab a"]).reshape(64, 64, 64)
    a, b = SYMBOL["a"], SYMBOL["b"]
    assert counts[0, 0, a] == 2 and counts[0, a, b] == 1 and counts[a, b, 0] == 1 and counts.sum() == 4
    assert trigram_counts([""]).sum() == 0 and trigram_counts(["中"]).reshape(64, 64, 64)[0, 0, OTHER] == 1


def test_viterbi_is_the_cheapest_reading(chars):
    r = random.Random(3)
    for _ in range(150):
        token = "".join(r.choice("ab1i0!$s-*") for _ in range(r.randint(1, 6)))

        def price(reading):
            total, a, b = 0.0, 0, 0
            for letter, channel in reading:
                total += channel
                if letter:
                    s = SYMBOL[letter]
                    total, a, b = total + chars.cost[a, b, s], b, s
            return total + chars.cost[a, b, 0]

        readings = list(itertools.product(*(options(token, i) for i in range(len(token)))))
        best = min(map(price, readings))
        got = decode(token, chars)
        assert min(price(x) for x in readings if "".join(c for c, _ in x) == got) == pytest.approx(best)


@pytest.mark.parametrize(("noisy", "word"), [
    ("1d10t", "idiot"), ("idi0t!", "idiot"), ("cl0wn", "clown"), ("L0$er", "loser"), ("stuuuupid", "stupid"), ("m.o.r.o.n", "moron"),
    ("i d i o t", "idiot"), ("s c u m", "scum"), ("tr@sh.", "trash"), ("p4th3tic", "pathetic"), ("w0rthle$$", "worthless"),
])
def test_restored_words(chars, noisy, word):
    assert word in restore_text(f"the {noisy} people", chars).split()


@pytest.mark.parametrize(("noisy", "word"), [
    ("$tupid", "stupid"), ("!diot", "idiot"), ("|oser", "loser"), ("(lown", "clown"), ("(l0wn", "clown"), ("$cum", "scum"), ("worthles$", "worthless"),
    ("stupid$$$", "stupid"), ("\"$tupid!!", "stupid"), ("(idiot)", "idiot"), ("m0ron!", "moron"), ("**scum**", "scum"),
])
def test_look_alikes_at_an_edge(chars, noisy, word):
    assert word in restore_text(f"the {noisy} people", chars).split()


def test_disguise_at_an_edge_is_scored(spark):
    clean = [f"good little tree number {i} the people" for i in range(300)]
    docs = spark.createDataFrame(
        [(i, t + " you stupid worthless scum" * (i % 2)) for i, t in enumerate(clean)]
        + [(1000, "good tree $tupid people"), (1001, "good tree worthles$ people"), (1002, "good tree $cum people"), (1003, "good tree! (people) *number*")],
        "doc_id bigint, text string",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, toxic int")
    scores = {r.doc_id: r.score for r in toxicity(docs, labels, fold).where("doc_id >= 1000").collect()}
    assert min(scores[1000], scores[1001], scores[1002]) > 10 * scores[1003]


def test_repeated_ids_are_one_text_each_in_the_sample(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("IF(id < 40, id, 1) AS doc_id", "concat('text ', id) AS text").unionByName(spark.sql("SELECT 2L AS doc_id, CAST(null AS string) AS text"))
    labels = spark.range(40).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    seen = []
    monkeypatch.setattr(noisy_channel, "train", lambda labelled, model: seen.append(labelled.collect()))
    toxicity(docs, labels, lambda i: i < 0).count()
    assert len(seen[0]) == len({r.key for r in seen[0]}) == 40 and sum(r.label for r in seen[0]) == 20


def test_clean_words_stay(chars):
    assert restore_text("Good tree, little people.", chars) == "good tree little people"
    assert restore_text("12 345 +1 (22)", chars) == "" == restore_text("", chars)


def test_logistic_fit():
    r = np.random.default_rng(1)
    x = (r.random((400, 12)) < 0.2).astype(np.float32)
    y = ((x[:, 0] + x[:, 3]) > 0).astype(float)
    w, bias = fit_logistic(x, y)
    assert (((x @ w + bias) > 0) == (y > 0)).mean() > 0.99


def fold(i):
    return F.crc32(i.cast("string").cast("binary")) % 5 == 0


def test_held_out_documents(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    rows = toxicity(read("documents").join(read("labels"), "doc_id", "left_semi"), read("labels"), fold).join(read("labels"), "doc_id").where("held_out").collect()
    hit = [(r.predicted, r.toxic) for r in rows]
    recall = sum(p for p, t in hit if t) / sum(t for _, t in hit)
    wrong = sum(p for p, t in hit if not t) / sum(1 - t for _, t in hit)
    assert recall > 0.85 and wrong < 0.02, (recall, wrong)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(i, f"good little tree number {i}" + " you idiot clown" * (i % 2), "x", 1) for i in range(200)]
        + [(900, None, "x", 1), (901, "", "x", 1), (902, "good tree 1d10t cl0wn", "x", 1), (None, "tree " * 50_000, "x", 1), (901, "", "x", 1)],
        "doc_id bigint, text string, toxic string, label int",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    rows = {r.doc_id: r for r in toxicity(docs, labels, fold).collect()}
    assert all(rows[i].predicted == i % 2 for i in range(200))
    assert [rows[i].predicted for i in (900, 901, 902, None)] == [0, 0, 1, 0]
    assert toxicity(docs, labels, fold).count() == 205
    assert {r.score for r in toxicity(docs, labels.limit(0), fold).collect()} == {0.0}
    assert toxicity(docs.limit(0), labels, fold).count() == 0
