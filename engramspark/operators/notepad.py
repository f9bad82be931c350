"""A flat notepad: ``notes(store_id, seq, date, content, citations)``.

Documents come out as ordered lines, so a notepad of any size is written by many tasks;
concatenating the lines of a store gives the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview, tokens_of_length, utf16_length
from .groups import ordinals

# Texts shown when there is nothing to show.
EMPTY = "(empty notepad)"
UNDATED = "undated"
NO_MATCH = "No matching notes found."


def note_line(ordinal: Column, date: Column, content: Column, citations: Column) -> Column:
    cites = F.array_join(F.transform(citations, lambda c: F.concat(F.lit("[exchange:"), c, F.lit("]"))), " ")
    return F.concat(
        ordinal.cast("string"), F.lit(". ["), date, F.lit("] "), content, F.lit(" "), cites
    )


def number_notes(notes: DataFrame) -> DataFrame:
    """Notes in date order (equal dates as written), numbered from 1."""
    return ordinals(notes, ["store_id"], ["date", "seq"], "ordinal").withColumn(
        "ordinal", F.col("ordinal") + 1
    )


def format_notes(notes: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """``(store_id, ordinal, line)``; a store without notes gets the empty sentinel."""
    lines = number_notes(notes).select(
        "store_id", "ordinal",
        note_line(F.col("ordinal"), F.col("date"), F.col("content"), F.col("citations")).alias("line"),
    )
    if stores is None:
        return lines
    bare = stores.select("store_id").join(notes, "store_id", "left_anti").select(
        "store_id", F.lit(0).cast("bigint").alias("ordinal"), F.lit(EMPTY).alias("line")
    )
    return lines.unionByName(bare)


def index_segments(notes: DataFrame, segment: int = 1000) -> DataFrame:
    """Previews grouped by date: ``(store_id, date_key, date_seq, segment, previews)``.

    A date line joins its previews with "; ". It is produced in segments of at most
    ``segment`` notes so that a date holding much of the notepad is not one row;
    ``date_seq`` orders the dates by first appearance.
    """
    dated = notes.select(
        "store_id", "seq", preview(F.col("content")).alias("preview"),
        F.when(F.coalesce("date", F.lit("")) == "", F.lit(UNDATED)).otherwise(F.col("date")).alias("date_key"),
    )
    parts = dated.groupBy("store_id", "date_key", F.floor(F.col("seq") / segment).alias("segment")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "preview"))), lambda s: s["preview"]), "; ").alias("previews"),
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("notes"),
    )
    first = dated.groupBy("store_id", "date_key").agg(F.min("seq").alias("date_seq"))
    return parts.join(first, ["store_id", "date_key"]).select(
        "store_id", "date_key", "date_seq", "segment", "notes", "previews"
    )


def search_notes(notes: DataFrame, queries: DataFrame, query_block: int = 256) -> DataFrame:
    """Notes containing ANY query word in their date or content; carries the ordinal.

    ``queries(store_id, query_id, query_text)``; a query without words finds nothing.
    Queries travel in blocks as one array, so a note meets a block per row and only
    its matches become rows.
    """
    terms = F.filter(F.split(F.lower("query_text"), r"\s+"), lambda t: t != "")
    sizes = queries.groupBy("store_id").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("_nb"))
    blocks = (
        queries.join(sizes, "store_id")
        .groupBy("store_id", F.pmod(F.xxhash64("query_id"), F.col("_nb")).alias("_b"))
        .agg(F.collect_list(F.struct("query_id", terms.alias("terms"))).alias("_queries"))
        .drop("_b")
    )
    text = F.lower(F.concat_ws(" ", F.coalesce("date", F.lit("")), "content"))
    hits = F.filter("_queries", lambda q: F.exists(q["terms"], lambda t: F.contains(F.col("_text"), t)))
    return (
        number_notes(notes).withColumn("_text", text).join(blocks, "store_id")
        .withColumn("query_id", F.explode(F.transform(hits, lambda q: q["query_id"])))
        .drop("_text", "_queries")
    )


def notepad_stats(notes: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Token size of the formatted notepad, number of notes and of distinct stored exchanges."""
    lines = format_notes(notes).groupBy("store_id").agg(
        (F.sum(utf16_length(F.col("line"))) + F.count(F.lit(1)) - 1).alias("_chars"),
        F.count(F.lit(1)).alias("note_count"),
    )
    stored = exchanges.select("store_id", "exchange_id").distinct().groupBy("store_id").agg(
        F.count(F.lit(1)).alias("exchange_count")
    )
    chars = F.coalesce("_chars", F.lit(len(EMPTY)))
    return lines.join(stored, "store_id", "full").select(
        "store_id", tokens_of_length(chars).alias("notepad_tokens"),
        F.coalesce("exchange_count", F.lit(0)).alias("exchange_count"),
        F.coalesce("note_count", F.lit(0)).alias("note_count"),
    )


def cited_exchanges(notes: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Each citation with the exchange it names, null when none is stored."""
    cited = notes.select("store_id", "seq", F.explode("citations").alias("exchange_id"))
    return cited.join(exchanges.select("store_id", "exchange_id", "text"), ["store_id", "exchange_id"], "left")


def upsert_exchanges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Latest text per ``(store_id, exchange_id)``; both sides carry ``version``."""
    both = stored.unionByName(new)
    return both.groupBy("store_id", "exchange_id").agg(
        F.max_by("text", "version").alias("text"), F.max("version").alias("version")
    )


def edit_notes(notes: DataFrame, edits: DataFrame, read_log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``edits(store_id, edit_no, seq, content)`` to notes that were read before.

    Notes are named by their stable ``seq``, so re-sorting cannot redirect an edit. Returns
    the new notes and one outcome row per edit. The last permitted edit of a note wins.
    """
    key = ["store_id", "seq"]
    known = notes.select(*key, F.lit(True).alias("_known"))
    read = read_log.select(*key).distinct().withColumn("_read", F.lit(True))
    judged = edits.join(known, key, "left").join(read, key, "left")
    error = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("Note #"), F.col("seq").cast("string"), F.lit(" does not exist.")))
        .when(F.col("_read").isNull(), F.concat(F.lit("Cannot edit note #"), F.col("seq").cast("string"), F.lit(": read it first.")))
    )
    outcome = judged.select("store_id", "edit_no", "seq", "content", error.isNull().alias("ok"), error.alias("error"))
    final = outcome.where("ok").groupBy(*key).agg(F.max_by("content", "edit_no").alias("_new"))
    rest = [c for c in notes.columns if c != "content"]
    edited = notes.join(final, key, "left").select(*rest, F.coalesce("_new", "content").alias("content"))
    return edited.select(*notes.columns), outcome.drop("content")


def add_notes(notes: DataFrame, entries: DataFrame) -> DataFrame:
    """Append ``entries`` (ordered by ``entry_no``) behind each store's last ``seq``."""
    last = notes.groupBy("store_id").agg(F.max("seq").alias("_last"))
    fresh = ordinals(entries, ["store_id"], ["entry_no"], "_i").join(last, "store_id", "left")
    return notes.unionByName(
        fresh.select(
            "store_id", (F.coalesce("_last", F.lit(-1)) + 1 + F.col("_i")).cast("bigint").alias("seq"),
            "date", "content", "citations",
        )
    )
