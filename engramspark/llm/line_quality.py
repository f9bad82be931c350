"""Line-first quality rules with built-in functions only.

Every line is judged by itself: markup and separators (navigation, tables), shouting, stuck words, missing punctuation,
boilerplate phrases, and repetition of an earlier line. Failing lines go; a document that loses too much of its text
with them goes as a whole. Documents too short or too repetitive fail before that. Everything is computed inside the row
that holds the text, so there is no shuffle, and nothing depends on how often a text or a source occurs.

A very long text is judged whole; its lines and words are arrays inside the row, which Spark bounds at 2 GB. Repeated lines of one
text: the first stays. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[ \\t-\\r]"
SYMBOLS = "[#*$%&|<>]"
STUCK = "(?<!\\S)(\\S++)(?:\\s++\\1(?!\\S)){4}"  # one word five times in a row
# fixed values: phrases of navigation, consent and licence lines
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "copyright (c)", "terms of service", "terms of use",
    "privacy policy", "cookie policy", "accept cookies", "enable javascript", "sign in to", "log in to", "subscribe to our",
    "click here to", "share this page", "back to top", "skip to content",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; shares are of characters."""

    min_words: int = 50
    max_repeat_pct: int = 50
    symbol_pct: int = 4
    shout_pct: int = 5
    plain_chars: int = 60  # a line this long needs some punctuation
    max_loss_pct: int = 50


def phrase_pattern() -> str:
    return "(?i)" + "|".join(p.replace("(", "\\(").replace(")", "\\)") for p in BOILERPLATE)


def line_passes(line: Column, rules: LineRules = LineRules()) -> Column:
    """Whether a line that has a word passes the rules that look at it alone."""
    chars = F.length(line)
    return ~(
        (F.regexp_count(line, F.lit(SYMBOLS)) * 100 > chars * rules.symbol_pct)
        | (F.regexp_count(line, F.lit("!")) * 100 > chars * rules.shout_pct)
        | ((chars >= rules.plain_chars) & ~line.rlike("[.,;:!?]"))
        | line.rlike(STUCK)
        | line.rlike(phrase_pattern())
    )


def judge(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """The whole input row as struct ``row`` with counts, verdict and cleaned text beside it.

    Counts: ``n_words`` (runs without ASCII white space), ``word_chars`` (their code points), ``n_symbols``, ``n_dup_lines`` (lines
    with a word that equal an earlier line), ``n_repeat_words`` (words in three-word windows that occur twice or more).
    ``base_failed``: too few words or too many repeated ones. ``kept``: not failed, and no more than ``max_loss_pct`` percent of the
    characters of lines were removed. ``clean_text``: the lines that pass, each once.

    Null and empty texts have zero counts, fail and have an empty clean text. Repeated rows are judged one by one.
    Columns of the input stay inside ``row``, so their names cannot clash.
    """
    words = F.array_remove(F.split("text", f"{SPACE}+"), "")
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    d = d.withColumns({"w": words, "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))})
    d = d.withColumns({
        "n_words": F.size("w").cast("bigint"),
        "word_chars": F.length(F.array_join("w", "")).cast("bigint"),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint"),
        "h": F.transform("w", lambda x: F.xxhash64(x)),
        "lines_once": F.array_distinct("lines"),
    })
    d = d.withColumns({
        "grams": F.transform(F.slice("h", 1, F.greatest(F.size("h") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2))),
        "n_dup_lines": (F.size("lines") - F.size("lines_once")).cast("bigint"),
        "passed": F.filter("lines_once", lambda x: line_passes(x, rules)),
    })
    # windows that occur again: sort (window, place), keep the places whose neighbour has the same window
    d = d.withColumn("places", F.when(
        F.size(F.array_distinct("grams")) < F.size("grams"),
        F.array_sort(F.transform("grams", lambda x, i: F.struct(x.alias("g"), i.alias("i")))),
    ))
    again = F.filter("places", lambda s, k: (s["g"] == F.get("places", k - 1)["g"]) | (s["g"] == F.get("places", k + 1)["g"]))
    d = d.withColumn("at", F.array_sort(F.transform(again, lambda s: s["i"])))
    steps = F.transform("at", lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get("at", k - 1))))
    d = d.withColumns({
        "n_repeat_words": F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint"),
        "line_chars": F.length(F.array_join("lines", "")).cast("bigint"),
        "kept_chars": F.length(F.array_join("passed", "")).cast("bigint"),
        "clean_text": F.array_join("passed", "\n"),
        "n_lines": F.size("lines").cast("bigint"),
        "n_kept_lines": F.size("passed").cast("bigint"),
    })
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_pct)
    lost = (F.col("line_chars") - F.col("kept_chars")) * 100 > F.col("line_chars") * rules.max_loss_pct
    return d.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~lost).alias("kept"), "n_lines", "n_kept_lines", "line_chars", "kept_chars", "clean_text",
    )


def verdicts(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the counts and the verdict of :func:`judge`, without texts."""
    return judge(docs, rules, text_col).select(F.col("row")[id_col].alias(id_col), F.expr("* except (row, clean_text)"))


def clean(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """The documents that are kept, with the columns of the input, the text without its failing lines.

    A column ``n_chars`` is set to the new number of code points if the input has one.
    """
    # explode, not where: a filter would be pushed below and every array function computed once more in its place
    kept = judge(docs, rules, text_col).select("row", F.explode(F.when(F.col("kept"), F.array("clean_text"))).alias("clean_text"))
    new = {text_col: F.col("clean_text"), "n_chars": F.length("clean_text").cast("bigint")}
    return kept.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
