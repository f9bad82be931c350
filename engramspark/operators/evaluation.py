"""Benchmark selection, scoring and dashboard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BUFFER_TOKEN_LIMIT
from .groups import top_rows

# Pass and partial marks of keyword recall.
PASS_MARK, PARTIAL_MARK = 0.75, 0.5


def select_items(items: DataFrame, count: int | None, question_type: str | None = None) -> DataFrame:
    """First ``count`` items per type in ``pos`` order; of one type when it is given; None is all."""
    if question_type is not None:
        items = items.where(F.col("question_type") == question_type)
    if count is None:
        return items
    return top_rows(items, ["question_type"], [F.col("pos")], count, "_n").drop("_n")


def question_types(items: DataFrame) -> DataFrame:
    """Distinct types with the position each first appears at."""
    return items.groupBy("question_type").agg(F.min("pos").alias("first_pos"))


def item_summaries(items: DataFrame) -> DataFrame:
    return items.select(
        "question_id", "question_type", "question", "answer",
        F.size("haystack_sessions").alias("session_count"),
    )


def question_detail(items: DataFrame, question_id: str) -> DataFrame:
    """The first item with this id, sessions reshaped to index and role/content turns."""
    sessions = F.transform(
        "haystack_sessions",
        lambda s, i: F.struct(
            i.alias("session_index"),
            F.transform(s, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"),
        ),
    )
    return (
        items.where(F.col("question_id") == question_id).orderBy("pos").limit(1)
        .select("question_id", "question_type", "question", "answer", "question_date",
                "haystack_dates", "answer_session_ids", sessions.alias("sessions"))
    )


def browse(items: DataFrame, text: str = "", question_type: str = "", limit: int = 50) -> DataFrame:
    """Type filter AND case-insensitive substring; the first ``limit`` in ``pos`` order."""
    if question_type:
        items = items.where(F.col("question_type") == question_type)
    if text:
        items = items.where(F.contains(F.lower("question"), F.lower(F.lit(text))))
    return items.orderBy("pos").limit(limit)


def accuracy_by_type(results: DataFrame) -> DataFrame:
    correct = F.sum(F.col("correct").cast("bigint"))
    return results.groupBy("question_type").agg(
        F.count(F.lit(1)).alias("total"), correct.alias("correct"),
        (correct * 100.0 / F.count(F.lit(1))).alias("accuracy_pct"),
    )


def overview(results: DataFrame) -> DataFrame:
    """Overall accuracy and mean times (seconds) and sizes; null without results."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.col("correct").cast("bigint")), F.lit(0)).alias("correct"),
        (F.avg(F.col("correct").cast("double")) * 100).alias("accuracy_pct"),
        (F.avg("indexing_ms") / 1000).alias("avg_index_s"),
        (F.avg("retrieval_ms") / 1000).alias("avg_retrieval_s"),
        F.avg("entities").alias("avg_entities"),
        F.avg("facts").alias("avg_facts"),
    )


def keyword_recall(answers: DataFrame) -> DataFrame:
    """Share of expected keywords found in each answer, with the grade.

    ``answers(question, answer, expected_keywords, test_type, difficulty, ...)``.
    """
    # the answer is lowered once, as the only element of an array, not once per keyword
    found = F.transform(
        F.array(F.lower("answer")),
        lambda low: F.filter("expected_keywords", lambda k: F.contains(low, F.lower(k))),
    )
    score = F.size("matched") / F.nullif(F.size("expected_keywords"), F.lit(0))
    return (
        answers.withColumn("matched", F.flatten(found))
        .withColumn("missed", F.filter("expected_keywords", lambda k: ~F.array_contains("matched", k)))
        .withColumn("score", score)
        .withColumn("grade", grade(F.col("score")))
    )


def grade(score: Column) -> Column:
    return F.when(score >= PASS_MARK, "PASS").when(score >= PARTIAL_MARK, "PARTIAL").otherwise("FAIL")


def recall_report(scored: DataFrame) -> DataFrame:
    """Mean score overall, by test type and by difficulty, from one pass."""
    by = F.explode(
        F.array(
            F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value")),
            F.struct(F.lit("test_type").alias("dimension"), F.col("test_type").alias("value")),
            F.struct(F.lit("difficulty").alias("dimension"), F.col("difficulty").alias("value")),
        )
    )
    return scored.select("score", by.alias("d")).groupBy("d.dimension", "d.value").agg(
        F.count(F.lit(1)).alias("tests"), F.avg("score").alias("mean_score")
    )


def chart_scales(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Upper ends of the token and graph-growth charts."""
    return snapshots.groupBy(*keys).agg(
        F.greatest(F.lit(BUFFER_TOKEN_LIMIT), F.max(F.greatest("tokens_peak", "tokens_after"))).alias("max_tokens"),
        F.greatest(F.lit(1), F.max(F.greatest("entities", "facts"))).alias("max_graph"),
    )
