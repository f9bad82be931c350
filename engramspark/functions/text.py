"""Column builders for identity and text rules.

String lengths are counted in UTF-16 code units, because stored identifiers and
token estimates are defined on them; Spark's own ``length`` counts code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CHARS_PER_TOKEN, NOTE_TYPES

# The 32-bit FNV-1a offset basis and prime.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK_32 = 4294967295

# White space as the identity rules see it (wider than Spark's trim).
SPACE_CLASS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def estimate_tokens(c: Column) -> Column:
    return tokens_of_length(utf16_length(c))


def tokens_of_length(n: Column) -> Column:
    return F.ceil(n / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def normalize_entity(c: Column) -> Column:
    return strip_space(F.lower(c))


def _fnv_step(h: Column, unit: Column) -> Column:
    return (h.bitwiseXOR(unit) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK_32))


def fnv1a_32(c: Column) -> Column:
    """FNV-1a over UTF-16 units, as a BIGINT; astral characters feed both surrogates."""

    def plain(h: Column, char: Column) -> Column:
        return _fnv_step(h, F.ascii(char))

    def paired(h: Column, char: Column) -> Column:
        cp = F.ascii(char).cast("bigint")
        high = F.lit(0xD800) + F.shiftright(cp - 0x10000, 10)
        low = F.lit(0xDC00) + (cp - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(cp < 0x10000, _fnv_step(h, cp)).otherwise(
            _fnv_step(_fnv_step(h, high), low)
        )

    start = F.lit(FNV_OFFSET).cast("bigint")
    chars = F.split(c, "")
    return (
        F.when(c == "", start)
        .when(utf16_length(c) == F.length(c), F.aggregate(chars, start, plain))
        .when(
            c.isNotNull(),
            F.aggregate(
                F.sequence(F.lit(1), F.length(c)), start, lambda h, i: paired(h, F.substring(c, i, F.lit(1)))
            ),
        )
    )


def hash_id(c: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.lower(F.hex(fnv1a_32(c))), 8, "0"))


def passage_key(counter: Column, raw_text: Column) -> Column:
    """Identity of a passage: its ordinal in the store plus the head of the raw text."""
    return hash_id(
        F.concat(F.lit("passage-"), counter.cast("string"), F.lit("-"), utf16_left(raw_text, 50)),
        "passage-",
    )


def utf16_left(c: Column, n: int) -> Column:
    """First ``n`` UTF-16 units; a pair cut in half is dropped rather than stored broken."""
    plain = F.substring(c, 1, n)
    units = F.encode(plain, "UTF-16BE")
    open_pair = F.hex(F.substring(units, 2 * n - 1, 1)).between("D8", "DB")
    keep = F.when(open_pair, 2 * n - 2).otherwise(2 * n)
    return F.when(utf16_length(plain) <= n, plain).otherwise(
        F.decode(F.substring(units, F.lit(1), keep), "UTF-16BE")
    )


def triple_text(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws(" ", s, p, o)


def display_triple(ordinal: Column, s: Column, p: Column, o: Column) -> Column:
    return F.concat(
        ordinal.cast("string"), F.lit(". ("), F.concat_ws(", ", s, p, o), F.lit(")")
    )


def preview(c: Column, n: int = 60) -> Column:
    return F.concat(utf16_left(c, n), F.when(utf16_length(c) > n, F.lit("...")).otherwise(F.lit("")))


def topic_words(topic: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(topic), "[-_]", " "), r"\s+")


def significant_name(name: Column) -> Column:
    """Names with more than two ASCII letters or digits may start similarity edges."""
    return F.length(F.regexp_replace(name, "[^A-Za-z0-9]", "")) > 2


def valid_types(types: Column) -> Column:
    kept = F.filter(F.coalesce(types, F.array().cast("array<string>")), lambda t: t.isin(*NOTE_TYPES))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("fact")))


def clamp_salience(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.5))))


def extract_json(c: Column) -> Column:
    """JSON inside a model reply: a fenced block, else the outermost braces, else the reply."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return (
        F.when(c.rlike(r"(?s)```(?:json)?\s*.*?```"), strip_space(fenced))
        .when(braces != "", braces)
        .otherwise(c)
    )


def verdict_is_correct(reply: Column) -> Column:
    v = F.upper(strip_space(reply))
    return v.contains("CORRECT") & ~v.contains("INCORRECT")


def compression_target(text: Column) -> Column:
    return F.greatest(F.lit(30), F.floor(estimate_tokens(text) / 4 + 0.5)).cast("bigint")


def format_passage(ordinal: Column, types: Column, topics: Column, text: Column) -> Column:
    return F.concat(
        F.lit("[Memory "), ordinal.cast("string"), F.lit("] ["), F.array_join(types, ","),
        F.lit("] ["), F.array_join(topics, ","), F.lit("]: "), text,
    )
