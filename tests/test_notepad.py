from engramspark.operators import notepad

SCHEMA = "store_id int, seq bigint, date string, content string, citations array<string>"


def notes(spark):
    return spark.createDataFrame([
        (1, 0, "2024-02-01", "later", ["e1", "e2"]), (1, 1, "2024-01-01", "x" * 61, []), (1, 2, "", "Kitchen plan", ["e9"]),
        (1, 3, "2024-02-01", "also later", []),
    ], SCHEMA)


def test_lines_are_in_date_order(spark):
    stores = spark.createDataFrame([(1,), (2,)], "store_id int")
    got = {(r.store_id, r.ordinal): r.line for r in notepad.format_notes(notes(spark), stores).collect()}
    assert got == {
        (1, 1): "1. [] Kitchen plan [exchange:e9]", (1, 2): "2. [2024-01-01] " + "x" * 61 + " ",
        (1, 3): "3. [2024-02-01] later [exchange:e1] [exchange:e2]", (1, 4): "4. [2024-02-01] also later ",
        (2, 0): "(empty notepad)",
    }


def test_index_groups_dates_as_first_seen(spark):
    rows = notepad.index_segments(notes(spark)).orderBy("date_seq").collect()
    assert [(r.date_key, r.previews) for r in rows] == [
        ("2024-02-01", "later; also later"), ("2024-01-01", "x" * 60 + "..."), ("undated", "Kitchen plan")]
    assert notepad.index_segments(notes(spark), 1).count() == 4


def test_search_matches_any_word_in_date_or_content(spark):
    q = spark.createDataFrame([(1, 1, "KITCHEN nothing"), (1, 2, "2024-02"), (1, 3, "   "), (1, 4, "absent")],
                              "store_id int, query_id int, query_text string")
    for block in (256, 1):
        got = sorted((r.query_id, r.seq) for r in notepad.search_notes(notes(spark), q, block).collect())
        assert got == [(1, 2), (2, 0), (2, 3)]


def test_edits_need_a_read(spark):
    edits = spark.createDataFrame([(1, 1, 0, "new"), (1, 2, 1, "no"), (1, 3, 9, "no"), (1, 4, 0, "newer")],
                                  "store_id int, edit_no int, seq bigint, content string")
    read = spark.createDataFrame([(1, 0)], "store_id int, seq bigint")
    after, outcome = notepad.edit_notes(notes(spark), edits, read)
    assert {r.seq: r.content for r in after.collect()}[0] == "newer"
    assert {r.edit_no: r.error for r in outcome.collect()} == {
        1: None, 4: None, 2: "Cannot edit note #1: read it first.", 3: "Note #9 does not exist."}


def test_adding_stats_and_citations(spark):
    more = spark.createDataFrame([(1, 5, "2024-03-01", "a", ["z"]), (2, 1, "", "b", [])],
                                 "store_id int, entry_no int, date string, content string, citations array<string>")
    got = sorted((r.store_id, r.seq) for r in notepad.add_notes(notes(spark), more).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0)]
    ex = spark.createDataFrame([(1, "e1", "text"), (1, "e1", "text"), (3, "e", "t")], "store_id int, exchange_id string, text string")
    stats = {r.store_id: (r.notepad_tokens, r.note_count, r.exchange_count) for r in notepad.notepad_stats(notes(spark), ex).collect()}
    lines = [r.line for r in notepad.format_notes(notes(spark)).collect()]
    assert stats == {1: (-(-len("\n".join(lines)) // 4), 4, 1), 3: (4, 0, 1)}
    cited = {r.exchange_id: r.text for r in notepad.cited_exchanges(notes(spark), ex.distinct()).collect()}
    assert cited == {"e1": "text", "e2": None, "e9": None}


def test_upsert_keeps_the_newest(spark):
    s = "store_id int, exchange_id string, text string, version int"
    got = notepad.upsert_exchanges(spark.createDataFrame([(1, "a", "old", 1)], s), spark.createDataFrame([(1, "a", "new", 2)], s)).collect()
    assert [(r.text, r.version) for r in got] == [("new", 2)]
