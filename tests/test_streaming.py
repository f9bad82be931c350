import time

from pyspark.sql import functions as F

from engramspark.sources.progress import EVENT
from engramspark.streaming.pressure_stream import flush_stream
from engramspark.streaming.progress_stream import progress_stream, publish


def test_flushes_follow_the_fold_across_batches(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "store_id string, seq bigint, exchange_text string"
    batches = [[("a", 0, "x" * 3000), ("b", 0, "hi")], [("a", 2, "z" * 10), ("a", 1, "y" * 3000)], [("a", 3, "w" * 5000)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = flush_stream(stream, lambda previous, buffer: f"{previous}S{len(buffer)}")
    q = (out.writeStream.format("memory").queryName("flushes").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).start())
    q.processAllAvailable()
    q.stop()
    rows = spark.table("flushes").orderBy("passage_seq").collect()
    assert {r.store_id for r in rows} == {"a"}
    assert [(r.passage_seq, r.flush_no, r.exchange_text[0]) for r in rows] == [(0, 1, "x"), (1, 1, "y"), (2, 2, "z"), (3, 2, "w")]
    assert rows[0].summary == "S6002"
    assert rows[2].summary == f"S6002S{len('[Summary]') + 1 + len('S6002') + 2 + 10 + 2 + 5000}"
    assert not any(r.lint for r in rows)


def test_progress_states(spark, tmp_path):
    src = str(tmp_path / "ev")
    schema = f"run_id int, seq bigint, event {EVENT}"
    rows = [(1, 0, {"type": "start", "totalTurns": 4, "totalQuestions": 1}), (1, 1, {"type": "question_start", "questionId": "q"}),
            (1, 2, {"type": "turn", "globalTurnsDone": 1, "globalTotalTurns": 4})]
    spark.createDataFrame(rows, schema).write.parquet(src)
    states = progress_stream(spark.readStream.schema(schema).parquet(src))
    q = publish(states, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("batch")).first()
    assert (got.active_question, got.global_turns_done, got.global_pct, got.running) == ("q", 1, 25.0, True)
