"""Best-fit packing by patterns: non-negative least squares on the length histogram.

Documents become token pieces of at most ``capacity`` tokens. Only the histogram of piece lengths, ``capacity`` numbers
however large the corpus, goes to the driver. There patterns of two and three pieces that fill a sequence exactly are
enumerated, their repeat counts fitted to the histogram by non-negative least squares and rounded, and what the
patterns leave is packed best fit, longest first, again on counts. The resulting plan has a few thousand rows.
Spark numbers the pieces of each length and every piece looks up its sequence and offset in the plan.
"""

from __future__ import annotations

import bisect
import functools
import json
import math
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramspark.llm.shared import settle
from engramspark.llm.token_counts import PRE_TOKENS, byte_symbols

LONG_RUN = 1000  # characters without white space
PATTERN_STEP = 16  # stride of the second length in patterns of three
FIT_STEPS = 400
FITTED_SHARE = 0.9  # of each length; the rest keeps a mix of lengths for the residual packing


class TextIds:
    """Token ids of whole texts under a byte-level vocabulary file, as little-endian 32-bit integers.

    Two libraries give the same ids: the one that the file is made for merges a pre-token of n bytes in n log n steps, the other
    one is several times faster on ordinary words but takes n^2 steps. So the latter reads the file's vocabulary as ranks, and
    texts with a very long run without white space go to the former.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, value = spec["model"]["vocab"], {c: i for i, c in enumerate(byte_symbols())}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.fast = None
        if made == sorted(made):  # ids follow the order of merges, so they can serve as ranks
            ranks = {bytes(value[c] for c in token): i for token, i in vocab.items() if token not in special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> bytes:
        if self.fast is None or max(map(len, text.split()), default=0) > LONG_RUN:
            found = np.asarray(self.library.encode(text, add_special_tokens=False).ids)
        else:
            found = self.fast.encode_to_numpy(text, allowed_special="all")
        return found.astype("<u4", copy=False).tobytes()


@functools.lru_cache(maxsize=2)
def text_ids(path: str) -> TextIds:
    return TextIds(path)


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: all are full but possibly the first."""
    full, rest = divmod(n, capacity)
    return [rest] * (rest > 0) + [capacity] * full


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. One pass over the scan, no shuffle."""

    def run(batches):
        import public_tokenizers

        library, end = text_ids(public_tokenizers.path(vocabulary)), np.uint32(end_id).astype("<u4").tobytes()
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for row, text in enumerate(texts):
                ids, at = library.ids(text) + end, 0
                for k, n in enumerate(piece_lengths(len(ids) // 4, capacity)):
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                    at += n
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def patterns(present: np.ndarray, capacity: int, step: int = PATTERN_STEP) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to ``capacity``: all pairs, and triples on a grid of the second length."""
    there = np.zeros(capacity + 1, dtype=bool)
    there[present] = True
    there[0] = True
    a = np.arange(1, capacity // 2 + 1)
    found = [np.stack([a, capacity - a, 0 * a], axis=1)]
    for first in range(1, capacity // 3 + 1):
        b = np.arange(first, (capacity - first) // 2 + 1, step)
        found.append(np.stack([np.full_like(b, first), b, capacity - first - b], axis=1))
    rows = np.concatenate(found)
    return rows[there[rows].all(axis=1)]


def fit_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2, by accelerated projected gradients.

    Column p of A counts how often each length occurs in pattern p.
    """
    size = len(histogram)
    weight = (rows > 0).astype(float).ravel()
    use = lambda x: np.bincount(rows.ravel(), weights=np.repeat(x, 3) * weight, minlength=size)
    back = lambda r: (r[rows] * weight.reshape(rows.shape)).sum(axis=1)
    v = np.ones(len(rows))
    for _ in range(30):  # largest eigenvalue of A'A
        v = back(use(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(use(y) - histogram) / (1.02 * top))
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit of counted lengths, longest first: (repeats, [(length, how many)]) of sequences with equal content."""
    closed: list[tuple[int, list[tuple[int, int]]]] = []
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []  # rooms with open sequences, ascending

    def put(room, count, content):
        if not count:
            return
        if not room:
            closed.append((count, content))
            return
        if not open_.get(room):
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append((count, content))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                count, content = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                room, content = capacity, []
                count = math.ceil(n / (room // length))
            each = room // length
            whole = min(count, n // each)
            rest = n - whole * each if whole < count else 0
            put(room - each * length, whole, [*content, (length, each)])
            if rest:
                put(room - rest * length, 1, [*content, (length, rest)])
            put(room, count - whole - (rest > 0), content)
            n -= whole * each + rest
    return closed + [x for groups in open_.values() for x in groups]


def plan(histogram: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their number within the length.

    Row (length, first number): pieces from this number on, ``mult`` of them in each sequence, go to the sequences from
    ``sequence`` on, the first at ``offset``.
    """
    left = histogram.astype(np.int64).copy()
    groups: list[tuple[int, list[tuple[int, int]]]] = [(int(left[capacity]), [(capacity, 1)])] if left[capacity] else []
    left[capacity] = 0
    rows = patterns(np.flatnonzero(left), capacity)
    if len(rows):
        x = fit_counts(rows, FITTED_SHARE * left)
        for p in np.argsort(-x, kind="stable"):
            if (want := int(x[p])) == 0:
                break
            content = [(int(v), int(c)) for v, c in zip(*np.unique(rows[p][rows[p] > 0], return_counts=True), strict=True)]
            if (can := min(want, *(int(left[v]) // c for v, c in content))) > 0:
                groups.append((can, content))
                for v, c in content:
                    left[v] -= can * c
    groups += best_fit(left, capacity)
    taken, out, sequence = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for count, content in groups:
        offset = 0
        for length, mult in content:
            out.append((length, int(taken[length]), mult, sequence, offset))
            taken[length] += count * mult
            offset += length * mult
        sequence += count
    out.sort()
    columns = np.array(out, dtype=np.int64).reshape(-1, 5).T
    return {"key": columns[0] << 44 | columns[1], "first": columns[1], "mult": columns[2], "sequence": columns[3], "offset": columns[4]}


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all texts into sequences of at most ``capacity`` tokens, one row per piece.

    Columns: id, piece, start, length, ids_crc32, sequence_id, offset. A text is its token ids and then ``end_id``; null and
    empty texts are the end alone. Texts longer than ``capacity`` are cut, the first piece takes what is over, and full
    pieces are sequences of their own. Repeated rows and repeated or null ids are packed like any others. An
    empty table gives no rows. Other columns are not read, whatever their names.

    The numbering of equal lengths is spread over sqrt(n) buckets per length, so a length that most pieces have is
    numbered by many tasks.
    """
    pieces = settle(token_pieces(docs, vocabulary, end_id, capacity, id_col, text_col))
    lengths = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in lengths:
        histogram[r["length"]] = r["count"]
    where = plan(histogram, capacity)
    buckets = max(1, math.isqrt(int(histogram.sum())))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    skipped = dealt.groupBy("length", "bucket").count().select(
        "length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip")
    )
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")
    numbered = dealt.withColumn("n", F.row_number().over(within).cast("bigint")).join(skipped, ["length", "bucket"])
    numbered = numbered.select("id", "piece", "start", "length", "ids_crc32", (F.col("skip") + F.col("n") - 1).alias("n"))

    def run(batches):
        for b in batches:
            length, n = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(where["key"], length << 44 | n, side="right") - 1
            k, mult = n - where["first"][at], where["mult"][at]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(where["sequence"][at] + k // mult), pa.array(where["offset"][at] + k % mult * length)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return numbered.mapInArrow(run, schema).withColumnRenamed("id", id_col)
