"""Benchmark datasets and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_array import array_elements

TURN = "struct<role:string,content:string,has_answer:boolean>"
ITEM = (
    "question_id string, question_type string, question string, answer string, question_date string, "
    "haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions string, "
    "answer_session_ids array<string>"
)
RESULT = (
    "question_id string, question_type string, question string, expected_answer string, "
    "generated_answer string, correct boolean, indexing_ms bigint, retrieval_ms bigint, "
    "passages bigint, entities bigint, facts bigint"
)
# File names of the two published dataset variants.
FILES = {"s": "longmemeval_s_cleaned.json", "oracle": "longmemeval_oracle.json"}


def dataset_path(folder: str, dataset: str = "oracle") -> str:
    """``s`` names the larger variant; anything else is the default one."""
    return f"{folder}/{FILES.get(dataset, FILES['oracle'])}"


def load_dataset(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Items of JSON array files (or one object of items), or of JSON lines; either way a file splits across tasks.

    Sessions may be lists of turns or objects with numbered keys; both become ``array<array<turn>>``. ``pos`` is the place in the file,
    dense from 0; with JSON lines it only keeps their order. Files of one folder follow each other by name.
    """
    if lines:
        raw = spark.read.schema(ITEM).json(path).withColumn("pos", F.monotonically_increasing_id())
    else:
        raw = array_elements(spark, path).select("pos", F.from_json("json", ITEM).alias("x")).select("x.*", "pos")
    as_list = lambda s: F.from_json(s, f"array<{TURN}>")
    as_object = lambda s: F.transform(
        F.array_sort(
            F.transform(F.map_entries(F.from_json(s, f"map<string,{TURN}>")),
                        lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("v")))
        ),
        lambda e: e["v"],
    )
    sessions = F.transform(
        F.from_json("haystack_sessions", "array<string>"),
        lambda s: F.when(F.ltrim(s).startswith("["), as_list(s)).otherwise(as_object(s)),
    )
    return raw.withColumn("haystack_sessions", sessions)


def turns_of(items: DataFrame) -> DataFrame:
    """``(store_id, session_index, pos, role, content, session_date)``; a missing date is ''."""
    sessions = items.select(
        F.col("question_id").alias("store_id"), "haystack_dates",
        F.posexplode("haystack_sessions").alias("session_index", "turns"),
    ).withColumn("session_date", F.coalesce(F.get("haystack_dates", F.col("session_index")), F.lit("")))
    return sessions.select(
        "store_id", "session_index", "session_date", F.posexplode("turns").alias("pos", "t")
    ).select("store_id", "session_index", "pos", "t.role", "t.content", "session_date")


def write_results(results: DataFrame, path: str, dataset: str, run_date: str) -> None:
    """Append one run as JSON, partitioned by dataset and date."""
    (
        results.withColumn("dataset", F.lit(dataset)).withColumn("run_date", F.lit(run_date))
        .write.mode("append").partitionBy("dataset", "run_date").json(path)
    )


def read_results(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Results of earlier runs; a file that does not hold result rows is refused."""
    df = spark.read.schema(f"{RESULT}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(
        path, multiLine=not lines
    )
    if not df.where(F.col("_bad").isNotNull() | F.col("question_id").isNull()).select("_bad", "question_id").isEmpty():
        raise ValueError("expected an array of result objects")
    return df.drop("_bad")
