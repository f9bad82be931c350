from pyspark.sql import functions as F

from engramspark.functions import text as tx


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def fnv(s):
    h = 2166136261
    data = s.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
    return f"{h:08x}"


def test_hash_ids_follow_utf16_units(spark):
    for s in ["", "alice", "José", "漢字", "a😀b", "passage-0-" + "x" * 50]:
        assert one(spark, s, lambda c: tx.hash_id(c, "entity-")) == "entity-" + fnv(s)


def test_lengths_and_tokens_count_utf16_units(spark):
    assert one(spark, "a😀b", tx.utf16_length) == 4
    assert one(spark, "x" * 4097, tx.estimate_tokens) == 1025
    assert one(spark, "", tx.estimate_tokens) == 0


def test_normalize_strips_wide_space(spark):
    assert one(spark, "\t  Foo Bar　\n", tx.normalize_entity) == "foo bar"


def test_left_never_splits_a_pair(spark):
    assert one(spark, "ab😀", lambda c: tx.utf16_left(c, 3)) == "ab"
    assert one(spark, "ab😀", lambda c: tx.utf16_left(c, 4)) == "ab😀"


def test_preview(spark):
    assert one(spark, "x" * 60, tx.preview) == "x" * 60
    assert one(spark, "x" * 61, tx.preview) == "x" * 60 + "..."


def test_extract_json(spark):
    assert one(spark, 'ok ```json\n{"a": 1}\n``` bye {"b": 2}', tx.extract_json) == '{"a": 1}'
    assert one(spark, 'x {"a": {"b": 1}} y', tx.extract_json) == '{"a": {"b": 1}}'
    assert one(spark, "nothing", tx.extract_json) == "nothing"


def test_verdict(spark):
    assert one(spark, " correct\n", tx.verdict_is_correct) is True
    assert one(spark, "INCORRECT", tx.verdict_is_correct) is False
    assert one(spark, "maybe", tx.verdict_is_correct) is False


def test_types_salience_and_short_names(spark):
    df = spark.createDataFrame([(["goal", "bogus"],), (["bogus"],), (None,)], "t array<string>")
    got = [r["r"] for r in df.select(tx.valid_types(F.col("t")).alias("r")).collect()]
    assert got == [["goal"], ["fact"], ["fact"]]
    vals = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "v double")
    assert [r[0] for r in vals.select(tx.clamp_salience(F.col("v"))).collect()] == [0.0, 1.0, 0.5]
    assert one(spark, "漢字漢字", tx.significant_name) is False
    assert one(spark, "a-b.c", tx.significant_name) is True


def test_topic_words_keep_the_empty_head(spark):
    assert one(spark, "-Real_estate agent", tx.topic_words) == ["", "real", "estate", "agent"]
