import numpy as np
import pytest

from engramspark.config import MemoryConfig
from engramspark.operators.conversation import pair_turns, turn_pair_counts
from engramspark.operators.pressure import lint_points, pressure_trace
from engramspark.plans.evaluate import session_exchanges, turn_snapshots


def turns(spark, rows):
    return spark.createDataFrame(
        rows, "store_id string, session_index int, pos int, role string, content string, session_date string"
    )


def test_pairs_by_position_with_an_odd_tail(spark):
    t = turns(spark, [("a", 0, 0, "system", "S", "d1"), ("a", 0, 1, "user", "U", "d1"), ("a", 0, 2, "assistant", "A", "d1"),
                      ("a", 1, 0, "user", "V", "")])
    got = {(r.session_index, r.exchange_index): r.exchange_text for r in pair_turns(t, with_date=True).collect()}
    assert got == {(0, 0): "[Session: d1]\nUser: S\nAssistant: U", (0, 1): "[Session: d1]\nUser: A", (1, 0): "User: V"}
    skipped = pair_turns(t, pairing="skip_system").where("session_index = 0").collect()
    assert [r.exchange_text for r in skipped] == ["User: U\nAssistant: A"]
    assert turn_pair_counts(t).first()["turn_pairs"] == 3


def plain_fold(sizes, compressed):
    held, out = 0, []
    for s in sizes:
        before = held
        held = held + 2 + s if held else s
        peak = held
        if -(-held // 4) > 1024:
            held = compressed
        out.append((-(-before // 4), -(-peak // 4), -(-held // 4), peak > 4096))
    return out


@pytest.mark.parametrize("block", [100_000, 7])
def test_pressure_fold_equals_a_loop(spark, block):
    rng = np.random.default_rng(1)
    sizes = {"a": [4096, 1, 4097, 10], "b": rng.integers(1, 3000, 60).tolist(), "c": rng.integers(1, 90, 200).tolist()}
    rows = [(k, i, "x" * int(n)) for k, ns in sizes.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "k string, i bigint, exchange_text string")
    trace = pressure_trace(df, ["k"], "i", compressed=20, config=MemoryConfig(fold_block=block))
    for k, ns in sizes.items():
        got = trace.where(trace.k == k).orderBy("i").collect()
        assert [(r.tokens_before, r.tokens_peak, r.tokens_after, r.summarized) for r in got] == plain_fold(ns, 20)
        flags = np.array([r.summarized for r in got])
        assert [r.events_before for r in got] == (np.cumsum(flags) - flags).tolist()
    b = trace.where("k = 'b' and summarized").orderBy("i").collect()
    assert [r.i for r in lint_points(trace).where("k = 'b'").orderBy("i").collect()] == [r.i for r in b[2::3]]


def test_snapshots_count_only_indexed_passages(spark):
    big = "x" * 3000
    t = turns(spark, [("q", s, p, "user", big, "") for s, n in ((0, 4), (1, 2)) for p in range(n)])
    ex = session_exchanges(t)
    triples = spark.createDataFrame(
        [("q", 0, 0, "a", "r", "b"), ("q", 1, 0, "a", "r", "c"), ("q", 2, 0, "d", "r", "e")],
        "store_id string, passage_seq bigint, ord int, subject string, predicate string, object string",
    )
    got = turn_snapshots(ex, triples, "s").orderBy("turn_index").collect()
    # each exchange overflows at once: 6000 characters of two turns
    assert [(r.turn_index, r.session_index, r.passages, r.entities, r.facts) for r in got] == [
        (0, 0, 1, 2, 1), (1, 0, 2, 3, 2), (2, 1, 3, 5, 3)]
    small = turns(spark, [("q", s, p, "user", "hi", "") for s, n in ((0, 4), (1, 2)) for p in range(n)])
    got = turn_snapshots(session_exchanges(small), triples, "s").orderBy("turn_index").collect()
    assert [(r.passages, r.entities) for r in got] == [(0, 0), (0, 0), (2, 3)]
