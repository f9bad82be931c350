"""Byte network: gradients by finite differences, held-out accuracy, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramspark.llm.byte_conv import ByteConv, ConvSettings, cut, identify, train


def fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def test_gradients():
    net = ByteConv(["a", "b", "c"], ConvSettings(window=12, embedding=3, filters=2))
    net.parameters = {k: v.astype(np.float64) for k, v in net.parameters.items()}
    r = np.random.default_rng(1)
    codes, target = r.integers(97, 103, (5, 12)).astype(np.uint8), r.integers(0, 3, 5)
    loss = lambda: -np.log(net.forward(codes)[0][np.arange(5), target]).mean()
    for k, g in net.gradients(codes, target).items():
        value = net.parameters[k]
        for at in [np.unravel_index(i, g.shape) for i in r.choice(g.size, min(g.size, 40), replace=False)]:
            if k == "filters" and not net.mask[at]:
                continue
            old = value[at]
            value[at] = old + 1e-6
            up = loss()
            value[at] = old - 1e-6
            down = loss()
            value[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_windows_cover_texts():
    codes, counts, sizes = cut([b"", b"abc", b"abcdefghi"], 4)
    assert counts.tolist() == [1, 1, 3] and sizes.tolist() == [0, 3, 4, 4, 1]
    assert codes.tobytes().replace(b"\0", b"") == b"abcabcdefghi"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs, fold()).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_copies_count_once_in_the_sample(spark, monkeypatch):
    words = spark.range(300).selectExpr("concat('text number ', id, ' of many') AS text", "'en' AS label")
    first = words.orderBy(F.xxhash64("text")).first().text  # its copies would fill all places
    copies = spark.range(5000).select(F.lit(first).alias("text"), F.lit("en").alias("label"))
    other = spark.range(50).selectExpr("concat('der Text ', id) AS text", "'de' AS label")
    seen = []
    monkeypatch.setattr(ByteConv, "fit", lambda self, codes, target: seen.append((codes, target)))
    assert train(words.unionByName(copies).unionByName(other), ConvSettings(per_label=200)).labels == ["de", "en"]
    codes, target = seen[0]
    assert [len(np.unique(codes[target == k], axis=0)) for k in (0, 1)] == [50, 200] == np.bincount(target).tolist()


def test_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "IF(doc_id % 3 = 0, null, lang) AS lang", "1 AS label")
    extra = spark.createDataFrame([(9000, None), (9001, ""), (9002, "12 34 ++"), (None, "the and of " * 40_000), (9001, "")], "doc_id bigint, text string")
    every = docs.unionByName(extra, allowMissingColumns=True)
    rows = {r.doc_id: r for r in identify(every, fold()).collect()}
    assert [rows[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3
    assert rows[None].lang_pred == "en" and not rows[None].held_out
    assert identify(every, fold()).count() == 205
    assert identify(docs.limit(0), fold()).count() == 0
    assert {r.lang_pred for r in identify(docs, F.lit(True)).collect()} == {"und"}
