"""Progress events of an evaluation run: emitting, parsing and folding them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators.groups import ordinals
from ..operators.pressure import prefix_sums
from ..session import materialize

EVENT = (
    "struct<type:string,questionIndex:bigint,questionId:string,questionType:string,question:string,"
    "turnsDone:bigint,totalTurns:bigint,globalTurnsDone:bigint,globalTotalTurns:bigint,"
    "totalQuestions:bigint,completed:bigint,total:bigint,message:string>"
)
PREFIX = "data: "
#: Longest stream that is put together from its chunks in one row.
JOINED_CHARS = 4_000_000


def parse_frames(chunks: DataFrame) -> DataFrame:
    """``chunks(stream_id, text)`` to ``(stream_id, frame, event)``.

    Frames end with a blank line; an unfinished tail, frames without the data prefix and malformed JSON are skipped. With a
    column ``chunk_no`` a stream is the concatenation of its chunks, and a frame may be cut anywhere between them.
    """
    if "chunk_no" in chunks.columns:
        frames = _joined_frames(chunks)
    else:
        frames = _whole_frames(chunks)
    line = F.trim(F.col("raw"))
    return (
        frames.where(line.startswith(PREFIX))
        .select("stream_id", "frame", F.from_json(F.substring(line, F.lit(len(PREFIX) + 1), F.length(line)), EVENT).alias("event"))
        .where(F.col("event.type").isNotNull())
    )


def _whole_frames(streams: DataFrame) -> DataFrame:
    parts = F.split("text", "\n\n")
    return streams.select("stream_id", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("frame", "raw"))


def _joined_frames(chunks: DataFrame) -> DataFrame:
    """Numbered frames of chunked streams, without the unfinished last one of each.

    Streams within ``JOINED_CHARS`` (counted first) are put together. In longer ones the pieces of a chunk get the number of
    blank lines before them, summed block by block, and pieces with one number are one frame. Line ends pair up from the first
    of a run on, so an odd one at the end of a chunk moves to the next chunk, and no blank line is cut.
    """
    stream = ["stream_id"]
    if (chunks.groupBy(*stream).agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] or 0) <= JOINED_CHARS:
        texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda s: s["text"])
        return _whole_frames(chunks.groupBy(*stream).agg(F.array_join(texts, "").alias("text")))
    sums = lambda df, keys, values: prefix_sums(df, keys, "_pos", values, DEFAULT.fold_block)
    placed = ordinals(chunks.select("stream_id", "chunk_no", F.coalesce("text", F.lit("")).alias("text")), stream, ["chunk_no"], "_pos")
    tail = F.length("text") - F.length(F.regexp_replace("text", "\n+\\z", ""))
    placed = materialize(placed.withColumn("tail", tail).withColumn("solid", (F.col("tail") < F.length("text")).cast("int")))
    earlier = placed.select("stream_id", (F.col("_pos") + 1).alias("_pos"), F.col("tail").alias("run"), F.col("solid").alias("cut"))
    runs = placed.join(earlier.hint("merge"), ["stream_id", "_pos"], "left").fillna(0, ["run", "cut"])
    runs = sums(sums(runs, stream, {"cut": "run_no"}), ["stream_id", "run_no"], {"run": "held"})
    got = F.col("held") % 2
    left = (F.when(F.col("solid") == 0, got).otherwise(0) + F.col("tail")) % 2
    mended = F.concat(F.repeat(F.lit("\n"), got.cast("int")), "text")
    mended = F.substring(mended, F.lit(1), (F.length(mended) - left).cast("int"))
    cut = runs.select("stream_id", "_pos", F.split(mended, "\n\n").alias("pieces")).withColumn("ends", F.size("pieces") - 1)
    flat = sums(cut, stream, {"ends": "upto"}).select("stream_id", "_pos", "ends", (F.col("upto") - F.col("ends")).alias("before"), F.posexplode("pieces").alias("i", "piece"))
    return flat.groupBy("stream_id", (F.col("before") + F.col("i")).alias("frame")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "piece"))), lambda s: s["piece"]), "").alias("raw"),
        F.bool_or(F.col("i") < F.col("ends")).alias("ended"),
    ).where("ended").drop("ended")


def event_frames(events: DataFrame) -> DataFrame:
    """``(run_id, seq, frame)`` wire text of event structs."""
    return events.select("run_id", "seq", F.concat(F.lit(PREFIX), F.to_json("event"), F.lit("\n\n")).alias("frame"))


def fold_progress(events: DataFrame) -> DataFrame:
    """Latest state per run from ``events(run_id, seq, event)``.

    Each field takes its newest setting event; the aggregates combine before the shuffle, so
    a run holding most events is no hot task. Also works on a stream of events.
    """
    e = F.col("event")
    of = lambda kind: e["type"] == kind
    newest = lambda value, cond: F.max_by(value, F.when(cond, F.col("seq")))
    last_start = F.max(F.when(of("question_start"), F.col("seq")))
    last_end = F.max(F.when(of("question_done") | of("done"), F.col("seq")))
    active = last_start.isNotNull() & (last_start > F.coalesce(last_end, F.lit(-1)))
    return events.groupBy("run_id").agg(
        newest(e["totalQuestions"], of("start")).alias("total_questions"),
        newest(F.coalesce(e["globalTotalTurns"], e["totalTurns"]), of("start") | of("turn")).alias("global_total_turns"),
        F.coalesce(newest(e["globalTurnsDone"], of("turn")), F.lit(0)).alias("global_turns_done"),
        F.coalesce(newest(e["completed"], of("question_done")), F.lit(0)).alias("questions_completed"),
        F.when(active, newest(e["questionId"], of("question_start"))).alias("active_question"),
        newest(e["message"], of("error")).alias("error"),
        (F.max(F.when(of("done"), 1)).isNull()).alias("running"),
    )


def with_percentages(state: DataFrame) -> DataFrame:
    pct = F.col("global_turns_done") * 100.0 / F.nullif(F.col("global_total_turns"), F.lit(0))
    return state.withColumn("global_pct", F.coalesce(pct, F.lit(0.0)))


def turn_events(snapshots: DataFrame, totals: DataFrame) -> DataFrame:
    """Turn events of a finished ingest: ``snapshots(run_id, question_index, turn_index,
    turns_before)`` with the turns of earlier questions, ``totals(run_id, question_index,
    total_turns, global_total_turns)``."""
    done = F.col("turn_index") + 1
    return snapshots.join(totals, ["run_id", "question_index"]).select(
        "run_id", "question_index", done.alias("turns_done"), "total_turns",
        (F.col("turns_before") + done).alias("global_turns_done"), "global_total_turns",
    )
