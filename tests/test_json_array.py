"""Array files cut anywhere against the standard parser."""

import json
import random

import pytest

from engramspark.sources.dataset import load_dataset
from engramspark.sources.json_array import array_elements


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that borders fall inside strings, escapes and brackets."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(n, None) for n in names]
    for n, v in zip(names, ("97", "0", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def value(r, depth=0):
    text = lambda: "".join(r.choice(['"', "\\", ",", "[", "}", "é", "漢😀", " ", "\n", "a", "],[", '{"', "\\\\"]) for _ in range(r.randrange(9)))
    kind = r.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return text()
    if kind == 1:
        return r.choice([1, -2.5, True, None])
    if kind < 4:
        return [value(r, depth + 1) for _ in range(r.randrange(4))] if kind == 3 else text()
    return {text() + str(i): value(r, depth + 1) for i in range(r.randrange(4))}


def test_any_cut_gives_the_elements_in_order(spark, tmp_path, small_splits):
    r, want = random.Random(6), []
    for n, size in enumerate((40, 0, 1, 7)):
        items = [value(r) for _ in range(size)]
        want += items
        (tmp_path / f"f{n}.json").write_text(json.dumps(items, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 2])))
    df = array_elements(spark, str(tmp_path))
    rows = df.orderBy("pos").collect()
    assert [x.pos for x in rows] == list(range(len(want)))
    assert [json.loads(x.json) for x in rows] == want


def test_an_object_gives_its_values(spark, tmp_path, small_splits):
    r = random.Random(7)
    held = {"b, c": value(r), "10": value(r), "2": {"x": '","'}, 'a"]': [1, [2, "}"]], "0": None, "07": 5}
    (tmp_path / "o.json").write_text(json.dumps(held))
    rows = array_elements(spark, str(tmp_path / "o.json")).orderBy("pos").collect()
    assert [json.loads(x.json) for x in rows] == [held[k] for k in ("0", "2", "10", "b, c", 'a"]', "07")]


def test_more_than_one_task_a_file(spark, tmp_path, small_splits):
    items = [{"question_id": f"q{i}", "question": "why, \"who\"?", "haystack_sessions": [[{"role": "user", "content": f"[{i}],"}]]} for i in range(60)]
    (tmp_path / "d.json").write_text(json.dumps(items))
    assert spark.read.option("lineSep", ",").text(str(tmp_path / "d.json")).rdd.getNumPartitions() > 20
    rows = load_dataset(spark, str(tmp_path / "d.json")).orderBy("pos").collect()
    assert [(x.question_id, x.haystack_sessions[0][0].content) for x in rows] == [(f"q{i}", f"[{i}],") for i in range(60)]
