"""The pipeline against the brute-force versions of its stages, one after the other."""

from collections import defaultdict

import pytest
from test_line_quality import brute as quality_brute
from test_mixing import brute as mixing_brute
from test_run_length_index import brute as repeats_brute
from test_superminhash import brute as near_brute

import corpus_pipeline
from engramspark.llm.pattern_packing import piece_lengths

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in documents.collect()]
    columns = documents.columns
    docs, got = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        got.append({r.doc_id: r.text for r in docs.collect()})
        docs = spark.createDataFrame(docs.collect(), documents.schema)
    cleaned = [(i, x[7], s, g) for i, t, s, g in rows if (x := quality_brute(t))[6]]
    assert got[0] == {r[0]: r[1] for r in cleaned}
    groups = near_brute([r[:2] for r in cleaned], 5, 80)
    single = [r for r in cleaned if groups[r[0]][2]]
    assert got[1] == {r[0]: r[1] for r in single}
    cut = [(r[0], x[4], *r[2:]) for r, x in zip(single, repeats_brute([r[1] for r in single], corpus_pipeline.REPEAT_BYTES, with_text=True), strict=True) if x[4]]
    assert got[2] == {r[0]: r[1] for r in cut}
    kept = {r[0] for r in mixing_brute(cut) if r[6]}
    assert got[3] == {r[0]: r[1] for r in cut if r[0] in kept}
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r.doc_id].append(r)
    assert pieces.keys() == got[3].keys()
    for mine in pieces.values():
        assert [r.length for r in sorted(mine, key=lambda r: r.piece)] == piece_lengths(sum(r.length for r in mine), 1024)


@pytest.mark.parametrize("rows", [
    [], [(1, None, None, None, None)], [(1, "", "en", "s", 0), (1, "", "en", "s", 0)],
    [(i, " ".join(f"w{i}x{j}," for j in range(90)) + ".", None, None, None) for i in (1, 2, 2, None)],
])
def test_odd_tables(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, h int, row string"
    docs = spark.createDataFrame([(*r, None, 1, "r") for r in rows], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.count()
