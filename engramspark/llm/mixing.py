"""Mixing sources to target weights by iterative proportional fitting, with built-in functions only.

Documents are counted into cells of source, language and topic. The cells' token weights are raked: scaled to the target share of
every source, then of every language, then of every topic, and again, until all margins hold together. What a cell should
weigh over what it does weigh gives its sampling rate; rates are scaled so that a budget of tokens is met, full cells
staying at 1. A document is kept if a hash of its id falls below its cell's rate.

Only the cells take part in the fitting. Sums are formed before every shuffle, so a source that holds a third of all rows
is one number per task.

Very long texts are only measured (length, a few substrings), never cut. Ids with equal hashes fall on the same side of a rate; repeated
rows do too. An empty table has no cells and gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramspark.llm.shared import settle

MARGINS = ("source", "lang", "topic")
BROADCAST_CELLS = 100_000


@dataclass(frozen=True)
class MixSettings:
    """Targets: each margin's shares are its token shares to a power, renormalised; 1 keeps them, 0 makes them equal."""

    powers: tuple[float, float, float] = (0.5, 0.7, 0.8)
    budget: float = 0.6  # share of all tokens to keep
    rounds: int = 8
    fills: int = 6
    salt: str = "mix:"


def topic_of(text: Column) -> Column:
    """Kind of content by marks in the whole text; the first that applies."""
    low = F.lower(text)
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("@"), "contact")
        .when(text.contains("="), "code")
        .when(low.contains("license") | low.contains("rights reserved"), "legal")
        .when(F.length(text) >= 4000, "long")
        .otherwise("prose")
    )


def token_weight(text: Column) -> Column:
    """A quarter of the bytes, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("bigint")


def uniform(id_: Column, salt: str) -> Column:
    """Number in [0, 1) that depends on the id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(id_.cast("string"), F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


def facts(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """row (the input), id, source, lang, topic, tokens. Null names count as empty ones, null texts as empty."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[id_col].alias("id"),
        F.coalesce(docs[source_col], F.lit("")).alias("source"), F.coalesce(docs[lang_col], F.lit("")).alias("lang"),
        topic_of(text).alias("topic"), token_weight(text).alias("tokens"),
    )


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int) -> DataFrame:
    """``cells`` (margins, w) with ``fit``: shares near w whose margins are ``targets`` (value, share). A value without a target gets nothing."""
    total = cells.agg(F.sum("w")).first()[0]
    fitted = cells.withColumn("fit", F.col("w") / F.lit(float(total or 1)))
    for _ in range(rounds):
        for m in MARGINS:
            now = fitted.groupBy(m).agg(F.sum("fit").alias("now"))
            scale = now.join(targets[m].withColumnRenamed("value", m), m, "left").select(
                m, F.when(F.col("now") > 0, F.coalesce("share", F.lit(0.0)) / F.col("now")).otherwise(0.0).alias("scale")
            )
            # written margin by margin: plans stay small on the driver
            fitted = settle(fitted.join(scale, m).select(*MARGINS, "w", (F.col("fit") * F.col("scale")).alias("fit")))
    return fitted


def rates(cells: DataFrame, settings: MixSettings = MixSettings(), targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Sampling rate of every cell: margins, w, ``rate`` in [0, 1].

    ``targets`` may replace a margin's tempered shares by a table (value, share).
    """
    cells = settle(cells)
    wanted = {}
    for m, power in zip(MARGINS, settings.powers, strict=True):
        if targets and m in targets:
            wanted[m] = targets[m]
            continue
        sums = cells.groupBy(F.col(m).alias("value")).agg(F.pow(F.sum("w").cast("double"), F.lit(power)).alias("t"))
        wanted[m] = settle(sums.select("value", (F.col("t") / F.lit(float(sums.agg(F.sum("t")).first()[0] or 1))).alias("share")))
    fitted = rake(cells, wanted, settings.rounds)
    total = float(fitted.agg(F.sum("w")).first()[0] or 0)
    scale = settings.budget * total
    for _ in range(settings.fills):  # what full cells cannot take goes to the others
        aim = F.col("fit") * F.lit(scale)
        full, rest = fitted.agg(
            F.coalesce(F.sum(F.when(aim >= F.col("w"), F.col("w").cast("double"))), F.lit(0.0)), F.coalesce(F.sum(F.when(aim < F.col("w"), aim)), F.lit(0.0))
        ).first()
        if rest <= 0:
            break
        scale *= (settings.budget * total - full) / rest
    return fitted.select(*MARGINS, "w", F.least(F.lit(1.0), F.col("fit") * F.lit(scale) / F.col("w")).alias("rate"))


def sampled(
    docs: DataFrame, settings: MixSettings = MixSettings(), targets: dict[str, DataFrame] | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """Every input row as struct ``row`` with id, source, lang, topic, ``tokens``, ``rate`` (9 decimals) and ``kept``.

    Rows without text weigh one token. Repeated ids are kept or left together, null ids too. An empty table
    gives no rows. Columns of the input stay inside ``row``, so their names cannot clash. The cells are sent to all tasks only
    if they are counted and few; more of them are joined by key.
    """
    rows = facts(docs, id_col, text_col, source_col, lang_col)
    cells = settle(rates(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("w")), settings, targets).select(*MARGINS, F.round("rate", 9).alias("rate")))
    side = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    return rows.join(side, list(MARGINS)).select(
        "row", "id", *MARGINS, "tokens", "rate", (uniform(F.col("id"), settings.salt) < F.col("rate")).alias("kept")
    )


def mix(docs: DataFrame, settings: MixSettings = MixSettings(), targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The documents that the calibrated sample keeps, with the columns of the input."""
    return sampled(docs, settings, targets).where("kept").select("row.*")
