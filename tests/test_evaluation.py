import json

import pytest
from pyspark.sql import functions as F

from engramspark.operators import evaluation
from engramspark.sources import dataset, progress

TURN = lambda c: {"role": "user", "content": c, "has_answer": False}
ITEMS = [
    {"question_id": "q1", "question_type": "b", "question": "Where is It?", "answer": "here", "question_date": "d",
     "haystack_dates": ["d1"], "haystack_session_ids": ["s"], "answer_session_ids": ["s"],
     "haystack_sessions": [[TURN("one"), TURN("two")], [TURN("three")]]},
    {"question_id": "q2", "question_type": "a", "question": "why", "answer": "so", "question_date": "d",
     "haystack_dates": [], "haystack_session_ids": [], "answer_session_ids": [],
     "haystack_sessions": [{"10": TURN("last"), "2": TURN("first")}]},
    {"question_id": "q3", "question_type": "b", "question": "what", "answer": "x", "question_date": "d",
     "haystack_dates": [], "haystack_session_ids": [], "answer_session_ids": [], "haystack_sessions": []},
]


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("data") / "items.json"
    path.write_text(json.dumps(ITEMS))
    return dataset.load_dataset(spark, str(path))


def test_both_session_layouts_load(items):
    turns = sorted((r.store_id, r.session_index, r.pos, r.content, r.session_date) for r in dataset.turns_of(items).collect())
    assert turns == [("q1", 0, 0, "one", "d1"), ("q1", 0, 1, "two", "d1"), ("q1", 1, 0, "three", ""),
                     ("q2", 0, 0, "first", ""), ("q2", 0, 1, "last", "")]


def test_selection_and_browsing(items):
    ids = lambda df: sorted(r.question_id for r in df.collect())
    assert ids(evaluation.select_items(items, 1)) == ["q1", "q2"]
    assert ids(evaluation.select_items(items, 5, "b")) == ["q1", "q3"]
    assert ids(evaluation.select_items(items, None)) == ["q1", "q2", "q3"]
    assert ids(evaluation.browse(items, "IS it")) == ["q1"]
    assert [r.question_type for r in evaluation.question_types(items).orderBy("first_pos").collect()] == ["b", "a"]
    assert {r.question_id: r.session_count for r in evaluation.item_summaries(items).collect()} == {"q1": 2, "q2": 1, "q3": 0}
    detail = evaluation.question_detail(items, "q1").first()
    assert detail.sessions[1].session_index == 1 and detail.sessions[1].turns[0].content == "three"
    assert evaluation.question_detail(items, "nope").count() == 0


def test_keyword_recall_and_report(spark):
    a = spark.createDataFrame([("q", "The RED fox", ["red", "fox", "cat", "Dog"], "direct", "easy"),
                               ("r", "all of it", ["all"], "detail", "easy"), ("s", "none", ["x"], "detail", "hard")],
                              "question string, answer string, expected_keywords array<string>, test_type string, difficulty string")
    scored = evaluation.keyword_recall(a)
    assert {r.question: (r.score, r.grade, r.missed) for r in scored.collect()} == {
        "q": (0.5, "PARTIAL", ["cat", "Dog"]), "r": (1.0, "PASS", []), "s": (0.0, "FAIL", ["x"])}
    got = {(r.dimension, r.value): r.mean_score for r in evaluation.recall_report(scored).collect()}
    assert got == {("overall", "all"): 0.5, ("test_type", "direct"): 0.5, ("test_type", "detail"): 0.5,
                   ("difficulty", "easy"): 0.75, ("difficulty", "hard"): 0.0}


def test_overview_of_nothing_is_null(spark):
    empty = spark.createDataFrame([], "correct boolean, indexing_ms bigint, retrieval_ms bigint, entities bigint, facts bigint")
    row = evaluation.overview(empty).first()
    assert (row.total, row.correct, row.accuracy_pct) == (0, 0, None)


def test_results_round_trip(spark, tmp_path):
    r = spark.createDataFrame([("q1", "b", True)], "question_id string, question_type string, correct boolean")
    dataset.write_results(r, str(tmp_path / "out"), "s", "2024-01-01")
    back = dataset.read_results(spark, str(tmp_path / "out/dataset=s"))
    assert [(x.question_id, x.correct) for x in back.collect()] == [("q1", True)]
    bad = tmp_path / "bad.json"
    bad.write_text('{"results": 1}\n')
    with pytest.raises(ValueError):
        dataset.read_results(spark, str(bad))


def test_frames_skip_tails_and_noise(spark):
    text = 'data: {"type":"start","totalTurns":4}\n\ndata: {oops\n\n: ping\n\ndata: {"type":"turn","globalTurnsDone":1}\n\ndata: {"type":"done"}'
    got = progress.parse_frames(spark.createDataFrame([(1, text)], "stream_id int, text string"))
    assert [(r.frame, r.event.type) for r in got.orderBy("frame").collect()] == [(0, "start"), (3, "turn")]


def events(spark, run, *kinds):
    rows = [(run, i, {"type": k, "questionId": f"q{i}", "globalTurnsDone": i, "totalTurns": 10, "completed": i, "message": "m"}) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, f"run_id int, seq bigint, event {progress.EVENT}")


def test_fold_tracks_the_active_question(spark):
    all_events = events(spark, 1, "start", "question_start", "turn", "turn").unionByName(
        events(spark, 2, "start", "question_start", "turn", "question_done", "error")).unionByName(
        events(spark, 3, "start", "question_start", "question_done", "done"))
    got = {r.run_id: r for r in progress.with_percentages(progress.fold_progress(all_events)).collect()}
    assert (got[1].active_question, got[1].global_turns_done, got[1].running, got[1].global_pct) == ("q1", 3, True, 30.0)
    assert (got[2].active_question, got[2].questions_completed, got[2].error) == (None, 3, "m")
    assert got[3].running is False


def test_event_frames(spark):
    e = spark.createDataFrame([(1, 0, ("done",))], "run_id int, seq int, event struct<type:string>")
    assert progress.event_frames(e).first()["frame"] == 'data: {"type":"done"}\n\n'


def test_chart_scales(spark):
    s = spark.createDataFrame([(1, 10, 5, 0, 0), (2, 2000, 50, 3, 9)], "q int, tokens_peak bigint, tokens_after bigint, entities bigint, facts bigint")
    assert {r.q: (r.max_tokens, r.max_graph) for r in evaluation.chart_scales(s, ["q"]).collect()} == {1: (1024, 1), 2: (2000, 9)}
