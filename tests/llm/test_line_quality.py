"""Line rules against a plain Python version."""

import re
from collections import Counter

from engramspark.llm.line_quality import BOILERPLATE, LineRules, clean, verdicts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = LineRules()


def line_ok(line):
    words = WORD.findall(line)
    return not (
        len(re.findall(r"[#*$%&|<>]", line)) * 100 > len(line) * R.symbol_pct
        or line.count("!") * 100 > len(line) * R.shout_pct
        or (len(line) >= R.plain_chars and not re.search("[.,;:!?]", line))
        or any(len(set(words[i : i + 5])) == 1 for i in range(len(words) - 4))
        or any(p in line.lower() for p in BOILERPLATE)
    )


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    passed = [x for x in dict.fromkeys(lines) if line_ok(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    total, kept = sum(map(len, lines)), sum(map(len, passed))
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed,
        not failed and not (total - kept) * 100 > total * R.max_loss_pct, "\n".join(passed),
    )


def result(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = verdicts(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert result(r) == brute(texts[r.doc_id])[:7], r.doc_id
    for r in clean(docs).collect():
        assert brute(texts[r.doc_id])[6:] == (True, r.text) and r.n_chars == len(r.text)


def test_edges(spark):
    good = " ".join(f"word{i}," for i in range(80)) + "."
    texts = [
        None, "", "   \n\t\n", "a b a b a b", good, good, good + "\n" + good, "x | y | z\n" * 3 + good, "go " * 5 + "\n" + good,
        good + "\nAll rights reserved.", "Wow!! " * 60, " ".join(f"w{i}" for i in range(90)), "a\x0bb\x0cc\rd e",
        " ".join(f"v{i % 997}" for i in range(30_000)), "same same same same same " + good,
    ]
    docs = spark.createDataFrame(
        [(i, t, "s", "r") for i, t in enumerate(texts)], "doc_id bigint, text string, kept string, row string"
    )
    rows = {r.doc_id: r for r in verdicts(docs).collect()}
    for i, t in enumerate(texts):
        assert result(rows[i]) == brute(t)[:7], i
    kept = clean(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {i: brute(t)[7] for i, t in enumerate(texts) if brute(t)[6]}
    assert clean(docs.limit(0)).count() == verdicts(docs.limit(0)).count() == 0
