"""The pressure fold with real summaries, whose text depends on all that came before.

A summary replaces the buffer, so a conversation is a chain of provider calls that nothing can shorten; conversations are
independent of each other. They are dealt to tasks once and every task walks its conversations in step, position by position: those
that overflow at one position are summarized in one batched call. A task holds one buffer per open conversation, and the number of
tasks follows the number of conversations, so memory is bounded whatever the lengths; a conversation with very many
exchanges streams through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens_of_length
from ..session import ship_package
from .pressure import LIMIT, SUMMARY_HEAD

PER_TASK = 2000  # conversations in step in one task

#: ``(previous summaries, buffers) -> new summaries``
Rolling = Callable[[Sequence[str], Sequence[str]], Sequence[str]]


def utf16_units(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def head_summary(buffer: str) -> str:
    """Summary a compressed buffer starts with, up to the first blank line."""
    if not buffer.startswith(SUMMARY_HEAD.rstrip()):
        return ""
    return buffer[len(SUMMARY_HEAD) :].split("\n\n")[0]


def keyword_rolling(previous: Sequence[str], buffers: Sequence[str]) -> list[str]:
    """Stand-in for a model: the head of the previous summary, then new words of four or more letters, more of them for a longer buffer."""
    word, out = re.compile(r"[^\W\d_]{4,}"), []
    for old, buffer in zip(previous, buffers, strict=True):
        kept = [w for w in old.split(" ")[:10] if w]
        new = dict.fromkeys(word.findall(buffer.lower()))
        out.append(" ".join([*kept, *list(new)[: max(8, utf16_units(buffer) // 64)]]))
    return out


def rolling_trace(
    exchanges: DataFrame, keys: Sequence[str], pos: str, summarize: Rolling = keyword_rolling, text: str = "exchange_text", per_task: int = PER_TASK
) -> DataFrame:
    """Fold each key's exchanges in ``pos`` order; a key whose ``pos`` has gaps is folded in order all the same.

    Returns keys, pos, tokens before / at peak / after, ``summarized``, ``events_before`` and the ``summary`` written there. Null texts
    count as empty. Key columns must not be null.
    """
    ship_package(exchanges.sparkSession)
    keys = list(keys)
    rows = exchanges.select(*keys, F.col(pos).cast("bigint").alias(pos), F.coalesce(F.col(text), F.lit("")).alias("text"))
    conversations = rows.agg(F.approx_count_distinct(F.struct(*keys))).first()[0]
    usual = int(exchanges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(usual, -(-conversations // per_task))
    key_types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    names = ["before_len", "peak_len", "after_len", "summarized", "events_before", "summary"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]

    def walk(batches) -> Iterator[pa.RecordBatch]:
        buffers: dict[tuple, str] = {}
        events: dict[tuple, int] = {}
        wave: dict[tuple, tuple] = {}
        place = None

        def settle_wave(key_fields: list[pa.Field]) -> pa.RecordBatch:
            """Every key of the wave moves on by one exchange; overflowing buffers share a provider call."""
            moved = []
            for key, new in wave.items():
                held = buffers.get(key, "")
                moved.append((key, held, f"{held}\n\n{new}" if held else new))
            over = [i for i, (_, _, peak) in enumerate(moved) if utf16_units(peak) > LIMIT]
            short = dict(zip(over, summarize([head_summary(moved[i][2]) for i in over], [moved[i][2] for i in over]), strict=True)) if over else {}
            out = []
            for i, (key, held, peak) in enumerate(moved):
                seen = events.get(key, 0)
                after = SUMMARY_HEAD + short[i].strip() if i in short else peak
                events[key], buffers[key] = seen + (i in short), after
                out.append((*key, place, utf16_units(held), utf16_units(peak), utf16_units(after), i in short, seen, short[i].strip() if i in short else None))
            wave.clear()
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [*(f.type for f in key_fields), pa.int64(), *types], strict=True)], names=[*keys, pos, *names]
            )

        fields: list[pa.Field] = []
        for b in batches:
            fields = [b.schema.field(c) for c in keys]
            for key, at, new in zip(zip(*(b.column(c).to_pylist() for c in keys), strict=True), b.column(pos).to_pylist(), b.column("text").to_pylist(), strict=True):
                if wave and (at != place or key in wave):
                    yield settle_wave(fields)
                place, wave[key] = at, new
        if wave:
            yield settle_wave(fields)

    dealt = rows.repartition(tasks, *keys).sortWithinPartitions(pos, *keys)
    traced = dealt.mapInArrow(walk, f"{key_types}, {pos} bigint, before_len bigint, peak_len bigint, after_len bigint, summarized boolean, events_before bigint, summary string")
    tokens = [tokens_of_length(F.col(f"{n}_len")).alias(f"tokens_{n}") for n in ("before", "peak", "after")]
    return traced.select(*keys, pos, *tokens, "summarized", "events_before", "summary")
