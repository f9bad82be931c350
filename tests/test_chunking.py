from engramspark.operators.chunking import chunk_exchanges, rerank_and_pack, split_text

A = "a" * 1024


def test_lengths_without_separators():
    assert split_text("a" * 1024) == ["a" * 1024]
    assert [len(c) for c in split_text("a" * 1025)] == [1024, 129]
    assert [len(c) for c in split_text("a" * 1800)] == [1024, 904, 8]


def test_hard_windows_carry_no_second_overlap():
    text = "".join(chr(97 + i % 26) for i in range(2000))
    got = split_text(text)
    assert got == [text[0:1024], text[896:1920], text[1792:2000]]


def test_coarsest_separator_wins_and_overlap_is_added():
    one, two, three = "x" * 600, "y" * 600, "z" * 300
    got = split_text(f"{one}\n\n{two}\n\n{three}")
    assert got == [one, one[-128:] + f"{two}\n\n{three}"]


def test_oversized_part_recurses_and_overlaps_again():
    words = " ".join(["w" * 99] * 20)
    head = "h" * 500
    got = split_text(f"{head}\n\n{words}\n\ntail")
    inner = split_text(words)
    assert len(inner) == 2
    pieces = [head, *inner, "tail"]
    assert got == [pieces[0]] + [a[-128:] + b for a, b in zip(pieces, pieces[1:])]


def test_leading_separators_vanish():
    assert split_text("\n\n" + A + "\n\n" + "q" * 10) == [A, A[-128:] + "q" * 10]


def test_astral_characters_count_twice():
    got = split_text("😀" * 600)
    assert len(got) == 2 and got[0] == "😀" * 512


def test_roles_and_blank_chunks(spark):
    df = spark.createDataFrame([(1, "User: hi\nAssistant: yo\nAssistant: again"), (2, "   "), (3, "User: only")], "id int, text string")
    got = [(r.id, r.role, r.chunk) for r in chunk_exchanges(df, "text").orderBy("id", "chunk_idx").collect()]
    assert got == [(1, "user", "User: hi"), (1, "assistant", "Assistant: yo\nAssistant: again"), (3, "user", "User: only")]


def test_pack(spark):
    q = spark.createDataFrame([("fits", "x"), ("none", "x"), ("over", "needle"), ("huge", "needle")], "query_id string, query_text string")
    p = spark.createDataFrame(
        [("fits", 1, "second"), ("fits", 0, "first"), ("over", 0, "hay " * 200), ("over", 1, "needle " * 100), ("huge", 0, "n" * 900)],
        "query_id string, passage_idx int, text string")
    got = {r.query_id: r.context for r in rerank_and_pack(q, p, budget=200).collect()}
    assert got["fits"] == "first\n\nsecond"
    assert got["none"] == "No relevant memories found."
    assert got["over"] == ("needle " * 100).strip()
    assert got["huge"] == "n" * 800
