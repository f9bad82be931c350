"""The fold with real summaries and the memory behind it, against one conversation at a time."""

import random

from pyspark.sql import functions as F

from engramspark.config import MemoryConfig
from engramspark.operators import rolling
from engramspark.plans import evaluate
from engramspark.sources.providers import KeywordExtractor, KeywordSummarizer

TURNS = "store_id string, session_index bigint, exchange_index bigint, exchange_text string"


def summarizer():
    """Length depends on the buffer, text on the previous summary; a function of its own for the workers."""
    return lambda previous, buffers: [f"{len(p)}:{p[-40:]} " + b[-(len(b) % 700) :] for p, b in zip(previous, buffers, strict=True)]


varying = summarizer()


def units(text):
    return len(text.encode("utf-16-le")) // 2


def fold(texts, summarize):
    buffer, events, out = "", 0, []
    for text in texts:
        before, peak = buffer, f"{buffer}\n\n{text}" if buffer else text
        summary = None
        if -(-units(peak) // 4) > 1024:
            old = peak[len("[Summary]\n") :].split("\n\n")[0] if peak.startswith("[Summary]") else ""
            (summary,) = summarize([old], [peak])
            summary = summary.strip()
        buffer = peak if summary is None else f"[Summary]\n{summary}"
        out.append((*(-(-units(x) // 4) for x in (before, peak, buffer)), summary is not None, events, summary))
        events += summary is not None
    return out


def sessions(seed):
    r = random.Random(seed)
    return {
        (f"s{s}", i): [r.choice(["é", "word ", "漢", "😀 ", "x\n\ny "]) * r.choice([0, 1, 40, 300, 900, 5000]) + f"{s}{i}{n}" for n in range(r.choice([1, 2, 7, 40]))]
        for s in range(6) for i in range(3)
    }


def test_fold_equals_one_conversation_at_a_time(spark):
    texts = sessions(1)
    rows = [(*key, n, t) for key, ts in texts.items() for n, t in enumerate(ts)]
    df = spark.createDataFrame(rows, TURNS)
    for summarize in (varying, rolling.keyword_rolling):
        got = {}
        for r in rolling.rolling_trace(df, ["store_id", "session_index"], "exchange_index", summarize, per_task=2).collect():
            got.setdefault((r.store_id, r.session_index), []).append((r.exchange_index, tuple(r)[3:]))
        assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {k: fold(ts, summarize) for k, ts in texts.items()}


def test_one_call_per_position(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting(previous, buffers):
        calls.add(1)
        return ["s"] * len(buffers)

    rows = [("s", i, n, "x" * 5000) for i in range(50) for n in range(3)]
    out = rolling.rolling_trace(spark.createDataFrame(rows, TURNS).withColumn("one", F.lit(1)), ["store_id", "session_index"], "exchange_index", counting)
    assert out.where("summarized").count() == 150
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert calls.value <= 3 * tasks


def test_empty(spark):
    assert rolling.rolling_trace(spark.createDataFrame([], TURNS), ["store_id"], "exchange_index").count() == 0
    one = rolling.rolling_trace(spark.createDataFrame([("s", 0, 0, None)], TURNS), ["store_id"], "exchange_index").collect()
    assert [tuple(r) for r in one] == [("s", 0, 0, 0, 0, False, 0, None)]


def test_sizes_between_flushes(spark):
    """With room for all, a snapshot counts what the flushes before it have indexed."""
    texts = sessions(2)
    rows, seq = [], {}
    for (store, session), ts in sorted(texts.items()):
        for n, t in enumerate(ts):
            rows.append((store, session, n, t, seq.get(store, 0)))
            seq[store] = seq.get(store, 0) + 1
    exchanges = spark.createDataFrame(rows, TURNS + ", passage_seq bigint")
    triples = F.array(F.struct(F.lit("a").alias("subject"), F.lit("is").alias("predicate"), F.concat(F.lit("b"), "passage_seq").alias("object")))
    extracted = exchanges.select("store_id", "passage_seq", triples.alias("triples"), F.lit(0.5).alias("salience"))
    for capacity in (10_000, 3):
        got = {(r.store_id, r.turn_index): r for r in evaluate.remembered_snapshots(exchanges, extracted, varying, MemoryConfig(max_passages=capacity)).collect()}
        for store, n in seq.items():
            mine = [got[store, i] for i in range(n)]
            assert all(r.passages <= min(capacity, r.turn_index + 1) and r.facts == r.passages and r.entities == r.passages + (r.passages > 0) for r in mine)
            flushed = [r.turn_index + 1 for r in mine if r.summarized]
            starts = [r.turn_index for r, before in zip(mine[1:], mine) if r.session_index != before.session_index]
            for r in mine:
                known = max([x for x in flushed if x <= r.turn_index + 1] + [x for x in starts if x <= r.turn_index] + [0])
                assert r.passages == min(capacity, known)


def test_words_of_any_script_and_any_length(spark):
    text = "Größe élève ñandú " * 30 + "Москва " * 10
    df = spark.createDataFrame([(text,), ("ab " * 9,), (None,), ("one two three four five six seven eight",)], "text string")
    rows = df.select(KeywordExtractor().column(F.col("text")).alias("x"), KeywordSummarizer().column(F.col("text"), F.lit(40)).alias("s")).collect()
    assert rows[0].x.summary == "größe élève ñandú москва" and rows[0].s == "größe élève ñandú москва"
    assert len(rows[0].x.triples) == 3 and rows[0].x.topics == ["größe", "élève", "ñandú", "москва"]
    assert rows[1].x.summary == "" and not rows[2].x.topics
    assert rows[3].x.summary == "eight five"
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000))
    (row,) = spark.createDataFrame([(long,)], "text string").select(KeywordExtractor().column(F.col("text")).alias("x")).collect()
    assert len(row.x.summary.split(" ")) == 500 and len(row.x.triples) == 5
