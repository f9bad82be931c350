import re

from pyspark.sql import functions as F

from engramspark.operators import compact
from engramspark.sources.providers import KeywordSummarizer, RemoteSummarizer


def test_buffer_growth_and_pressure(spark):
    df = spark.createDataFrame([("", "a"), (None, "a"), ("b", "a")], "buffer string, ex string")
    assert [r[0] for r in df.select(compact.append_exchange(F.col("buffer"), F.col("ex"))).collect()] == ["a", "a", "b\n\na"]
    sizes = spark.createDataFrame([("x" * 4096,), ("x" * 4097,)], "b string")
    assert [r[0] for r in sizes.select(compact.should_summarize(F.col("b"))).collect()] == [False, True]


def test_summaries(spark):
    ex = spark.createDataFrame([(1, 1, "Bravo bravo charlie"), (1, 0, "alpha words")], "k int, pos int, exchange_text string")
    short = compact.summarize_exchanges(ex, KeywordSummarizer())
    assert {r.pos: r.summary for r in short.collect()} == {0: "alpha words", 1: "bravo charlie"}
    told = compact.summarize_summaries(short, ["k"], "pos", RemoteSummarizer(lambda text, n: f" {text}|{n} ")).first()
    assert told.narrative == "[Summary of earlier conversation]\nalpha words\n\nbravo charlie|30"


def test_long_sessions_are_told_in_rounds(spark):
    """No prompt holds more than ``fan`` parts, whatever the length; order is kept."""
    sizes = spark.sparkContext.accumulator(0)

    def told(text, n):
        parts = text.split("\n\n")
        if len(parts) > 3:
            sizes.add(1)
        return f"({' '.join(p.strip() for p in parts)})"

    rows = [("a", i, f"s{i}") for i in range(20)] + [("b", 0, "only")]
    short = spark.createDataFrame(rows, "k string, pos int, summary string")
    got = {r.k: r.narrative for r in compact.summarize_summaries(short, ["k"], "pos", RemoteSummarizer(told), fan=3).collect()}
    assert re.findall(r"s\d+", got["a"]) == [f"s{i}" for i in range(20)] and got["a"].count("(") == 7 + 3 + 1
    assert "only" in got["b"] and sizes.value == 0
    assert compact.summarize_summaries(short.limit(0), ["k"], "pos", RemoteSummarizer(told)).count() == 0
