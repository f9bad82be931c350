"""Removal of long repeats with a run-length compressed suffix index.

Every text window of ``length`` bytes has a seed: the smallest hash of the short grams in it. Equal windows have equal seeds at equal
offsets, so occurrences of a repeat meet where their seeds are dealt to, and nowhere are two documents paired. The
windows that one seed stands for are a segment; segments that occur twice as they are need no index. For the others, an
index over all segments of a batch of seeds is built in the task:

* the suffix order gives the Burrows-Wheeler transform, kept as runs of equal symbols;
* the suffix positions and the match lengths with their neighbours are sampled at run heads and run ends only;
* inside a run a match length falls by one with each step to the right, so streaming the segments over the samples gives, for
  every position, how long a match it has anywhere else (its matching statistic).

A window is a repeat if the statistic at its start reaches ``length``.

Texts are taken whole; seeds of one text need about 32 bytes per byte (638 MB for 20 MB measured), which bounds the texts a worker can
take. Equal hashes in a window: the rightmost, in every text alike. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramspark.llm.shared import settle, slices
from engramspark.llm.winnowing import gram_hashes

GRAM = 64
CHUNK = 1 << 20  # bytes of segments in one index
HOT_SEGMENTS = 4000  # a seed with more segments is decided by counting its windows


def window_seeds(hashes: np.ndarray, w: int) -> np.ndarray:
    """For every window of w hashes the place of its minimum, the rightmost one on ties."""
    best, span = np.arange(len(hashes)), 1
    while span < w:
        step = min(span, w - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(hashes[b] <= hashes[a], b, a)
        span += step
    return best


def segments_of(data: bytes, length: int, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(seed, first window, last window, place of the seed) for all windows of a text, in order."""
    if len(data) < length:
        return
    hashes = gram_hashes(np.frombuffer(data, dtype=np.uint8), gram).view(np.int64)
    best = window_seeds(hashes, length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.append(first[1:], len(best)) - 1
    place = best[first]
    yield from zip(hashes[place].tolist(), first.tolist(), last.tolist(), place.tolist(), strict=True)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans as ascending spans that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


class RunLengthIndex:
    """Runs of the BWT of some byte strings, with suffix positions and match lengths sampled at both ends of every run."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings])
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        text = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8).astype(np.int64) + len(strings)
        text[self.starts + sizes] = np.arange(len(strings))  # every string ends with a symbol of its own
        self.size = n = len(text)
        ranks, order = self.sort(text)
        symbol = text[order - 1]  # of the suffix before, cyclic
        head = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        tail = np.append(head[1:], n) - 1
        self.symbols, self.lengths = symbol[head], np.diff(np.append(head, n))
        up, down = head[head > 0], tail[tail < n - 1]
        first, last = order[head[:1]], order[tail[-1:]]  # the ends of the suffix order match nothing beyond
        zero = np.zeros(1, dtype=np.int64)
        self.heads = self.sampled(np.concatenate([order[up], first]), np.concatenate([self.match(ranks, order[up], order[up - 1]), zero]))
        self.tails = self.sampled(np.concatenate([order[down], last]), np.concatenate([self.match(ranks, order[down], order[down + 1]), zero]))

    @staticmethod
    def sort(text: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Ranks of prefixes of doubling length, and the suffix order.

        Below 2^21 symbols two ranks and a place fit one number, and numbers sort many times faster than places by number. From
        there on ranks pass 21 bits: two ranks of up to 31 bits are a number, and places are sorted by it.
        """
        n, width, packed = len(text), 1, len(text) < 1 << 21
        bits = 21 if packed else 32
        rank = (text + 1).astype(np.int32)
        ranks = [(1, rank)]
        while True:
            key = rank.astype(np.int64) << bits
            key[: n - width] |= rank[width:] + np.int64(ranks[-1] is not ranks[0])
            if packed:
                key = key << 21 | np.arange(n)
                key.sort()
                order = key & (1 << 21) - 1
                key >>= 21
            else:
                order = np.argsort(key)
                key = key[order]
            width *= 2
            rank = np.empty(n, dtype=np.int32)
            rank[order] = np.cumsum(np.concatenate([[0], np.diff(key) != 0]), dtype=np.int32)
            ranks.append((width, rank))
            if rank[order[-1]] == n - 1:
                return ranks, order

    @staticmethod
    def match(ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, from the ranks of prefixes."""
        n = len(ranks[0][1])
        a, b, total = a.astype(np.int64), b.astype(np.int64), np.zeros(len(a), dtype=np.int64)
        for width, rank in ranks[::-1]:
            same = (a < n) & (b < n)
            same[same] = rank[a[same]] == rank[b[same]]
            total[same] += width
            a, b = a + same * width, b + same * width
        return total

    @staticmethod
    def sampled(place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(place)
        return place[by], value[by]

    def matching_statistics(self, start: int, size: int) -> np.ndarray:
        """For ``size`` text positions from ``start`` on, the longest match of the text there with any other place."""
        at, out = np.arange(start, start + size), np.zeros(size, dtype=np.int64)
        for place, value in (self.heads, self.tails):
            k = np.searchsorted(place, at, side="right") - 1
            known = k >= 0
            out[known] = np.maximum(out[known], value[k[known]] - (at[known] - place[k[known]]))
        return out


def repeated_windows(strings: list[bytes], stream: list[bool], length: int) -> Iterator[tuple[int, int, int]]:
    """(string, first byte, last byte + 1) of maximal runs of repeated windows in the strings to stream."""
    index = RunLengthIndex(strings)
    for i, (s, wanted) in enumerate(zip(strings, stream, strict=True)):
        if wanted:
            hit = index.matching_statistics(int(index.starts[i]), len(s) - length + 1) >= length
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                yield i, a, b - 1 + length


def digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def common_seeds(source: DataFrame, length: int, gram: int) -> DataFrame:
    """Seeds of more than one segment. Counted before segments are digested: most segments are alone and never leave their task."""

    def run(batches):
        for b in slices(batches, 200):
            found: dict[int, int] = {}
            for text in b.column(2).to_pylist():
                for seed, *_ in segments_of((text or "").encode(), length, gram):
                    found[seed] = found.get(seed, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["seed", "times"])

    counted = source.mapInArrow(run, "seed bigint, times bigint").groupBy("seed").agg(F.sum("times").alias("times"))
    return counted.where("times > 1").select(F.col("seed").alias("key"), F.lit(True).alias("common"))


def seed_rows(source: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of all texts: seed, id, h, first, n (windows), s1, s2 (segment content and seed offset), m (times in the text).

    A segment that occurs several times in one text is one row; the places of the others come as rows without a seed.
    """

    def run(batches):
        for b in slices(batches):
            out: list[list] = [[] for _ in range(8)]
            for row, text in enumerate(b.column(2).to_pylist()):
                data, own = (text or "").encode(), {}
                for seed, first, last, place in segments_of(data, length, gram):
                    own.setdefault((seed, *digest(data[first : last + length] + b"%d" % (place - first))), []).append((first, last))
                spans = merged([(a, z + 1) for places in own.values() if len(places) > 1 for a, z in places])
                for (seed, s1, s2), places in own.items():
                    first, last = places[0]
                    for column, v in zip(out, (row, seed, first, last - first + 1, s1, s2, len(places)), strict=False):
                        column.append(v)
                for a, z in spans:
                    for column, v in zip(out, (row, None, a, z - a, None, None, None), strict=False):
                        column.append(v)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), *(pa.array(c, pa.int64()) for c in out[1:7])],
                names=["id", "h", "seed", "first", "n", "s1", "s2", "m"],
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, h bigint, seed bigint, first bigint, n bigint, s1 bigint, s2 bigint, m bigint")


ENTRY = "array<struct<first:bigint,n:bigint,seed:bigint,segments:bigint,twice:boolean>>"
RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"


def long_repeats(
    docs: DataFrame, length: int = 400, gram: int = GRAM, hot: int = HOT_SEGMENTS, chunk: int = CHUNK,
    id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for, ``kept_text``.

    ``kept_text`` leaves out what a removal has cut from a character of several bytes. Columns named in ``carry`` come along as
    fields of a struct ``rest``.

    Removed is every byte (UTF-8) that a string of ``length`` bytes covers which also starts anywhere else, in the same text or another;
    matches never cross texts. Null and empty texts have no bytes. Repeated rows are places of their own, so a text
    of ``length`` bytes or more that comes twice is removed wholly from both. Null ids and further columns do no harm.

    A seed with more than ``hot`` segments (a passage with very many surroundings) is not put into one index; its windows are
    counted by digest, which gives the same answer.
    """
    rest = F.struct(*[docs[f"`{c}`"] for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    source = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("text"), rest.alias("rest"))
    kind = source.schema["id"].dataType.simpleString()
    with_rest = lambda ddl: T.StructType([*T.StructType.fromDDL(ddl).fields, source.schema["rest"]])
    texts = source.drop("rest")
    # local rows have no seed and are dealt by their text
    rows = seed_rows(texts, length, gram).withColumn("key", F.coalesce("seed", "h")).join(common_seeds(texts, length, gram), "key", "left")
    rows = settle(rows.where("seed IS NULL OR common").drop("key", "common"))
    parts = rows.where("seed IS NOT NULL").groupBy("seed", "s1", "s2").agg(F.sum("m").alias("m"), F.min(F.struct("id", "h", "first")).alias("rep"))
    seeds = parts.groupBy("seed").agg(F.count(F.lit(1)).alias("segments"), F.min("m").alias("least"), F.sum("m").alias("total")).where("total > 1")
    live = parts.join(seeds, "seed").selectExpr("seed", "s1", "s2", "m > 1 AS twice", "segments", "segments > 1 AND least = 1 AS mixed", "rep")
    mine = F.struct("id", "h", "first").eqNullSafe(F.col("rep"))
    hits = rows.join(live, ["seed", "s1", "s2"]).withColumn("read", F.col("mixed") & (~F.col("twice") | mine))
    entries = hits.select("id", "h", "first", "n", F.when(F.col("read"), F.col("seed")).alias("seed"), "segments", "twice")
    local = rows.where("seed IS NULL").selectExpr("id", "h", "first", "n", "CAST(null AS bigint) AS seed", "0L AS segments", "true AS twice")
    lists = entries.unionByName(local).groupBy("id", "h").agg(F.collect_list(F.struct("first", "n", "seed", "segments", "twice")).alias("entries"))
    lists = lists.select(F.col("id").alias("lid"), F.col("h").alias("lh"), "entries")
    joined = source.join(lists, F.col("id").eqNullSafe(F.col("lid")) & (F.col("h") == F.col("lh")), "left").select("id", "h", "text", "entries", "rest")

    def outcome(data: bytes, spans: list[tuple[int, int]]) -> tuple:
        spans = merged(spans)
        kept = without(data, spans)
        return len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None

    result_types = [pa.int64()] * 3 + [pa.string(), pa.string()]
    result_names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]

    def resolve(batches):
        """Texts whose segments all are decided are done; the others go on with their entries."""
        for b in slices(batches):
            done, more = [], []
            for text, entries in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = (text or "").encode()
                if entries and any(e["seed"] is not None for e in entries):
                    done.append((None,) * 5)
                    more.append((data, entries))
                else:
                    done.append(outcome(data, [(e["first"], e["first"] + e["n"] - 1 + length) for e in entries or ()]))
                    more.append((None, None))
            values = list(zip(*done, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(values, result_types, strict=True)),
                    pa.array([m[0] for m in more], pa.binary()), pa.array([m[1] for m in more], b.schema.field(3).type), b.column(4),
                ],
                names=["id", "h", *result_names, "data", "entries", "rest"],
            )

    state = settle(joined.mapInArrow(resolve, with_rest(f"id {kind}, h bigint, {RESULT}, data binary, entries {ENTRY}")))
    open_ = state.where("data IS NOT NULL").select("id", "h", "data", "entries", "rest")
    asked = open_.select("id", "h", "data", F.explode("entries").alias("e")).where("e.seed IS NOT NULL").select(
        "id", "h", F.col("e.seed").alias("seed"), F.col("e.segments").alias("segments"), (~F.col("e.twice")).alias("stream"), F.col("e.first").alias("first"),
        F.expr(f"substring(data, CAST(e.first + 1 AS int), CAST(e.n - 1 + {length} AS int))").alias("data"),
    )

    span_type = f"id {kind}, h bigint, first bigint, past bigint"

    def indexed(batches):
        """Rows come sorted by seed; an index takes whole seeds."""
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            ids = b.schema.field(0).type
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= chunk and r[2] != last:
                    yield spans(held, ids)
                    held, size = [], 0
                held.append(r)
                size, last = size + len(r[5]), r[2]
        if held:
            yield spans(held, ids)

    def spans(held: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        found = [(held[i], a, z) for i, a, z in repeated_windows([r[5] for r in held], [r[3] for r in held], length)]
        columns = [[r[0] for r, _, _ in found], [r[1] for r, _, _ in found], [r[4] + a for r, a, _ in found], [r[4] + z for r, _, z in found]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (ids, pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["id", "h", "first", "past"]
        )

    columns = ["id", "h", "seed", "stream", "first", "data"]
    by_index = asked.where(F.col("segments") <= hot).select(*columns).repartition("seed").sortWithinPartitions("seed").mapInArrow(indexed, span_type)

    def windows(batches):
        for b in slices(batches, 100):
            out: list[list] = [[] for _ in range(5)]
            for row, (stream, first, data) in enumerate(zip(*(b.column(c).to_pylist() for c in (3, 4, 5)), strict=True)):
                for i in range(len(data) - length + 1):
                    for column, v in zip(out, (row, first + i, *digest(data[i : i + length]), 1 if stream else 2), strict=True):
                        column.append(v)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), *(pa.array(c, pa.int64()) for c in out[1:])], names=["id", "h", "first", "d1", "d2", "m"]
            )

    single = asked.where(F.col("segments") > hot).select(*columns).mapInArrow(windows, f"id {kind}, h bigint, first bigint, d1 bigint, d2 bigint, m bigint")
    often = single.groupBy("d1", "d2").agg(F.sum("m").alias("times")).where("times > 1")
    by_count = single.where("m = 1").join(often, ["d1", "d2"]).selectExpr("id", "h", "first", f"first + {length} AS past")
    found = by_index.unionByName(by_count).groupBy("id", "h").agg(F.collect_list(F.struct("first", "past")).alias("found"))
    found = found.select(F.col("id").alias("fid"), F.col("h").alias("fh"), "found")
    last = open_.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh")), "left").select("id", "data", "entries", "found", "rest")

    def finish(batches):
        for b in slices(batches):
            done = [
                outcome(data, [(e["first"], e["first"] + e["n"] - 1 + length) for e in entries if e["twice"]] + [(f["first"], f["past"]) for f in found or ()])
                for data, entries, found in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)
            ]
            values = list(zip(*done, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(values, result_types, strict=True)), b.column(4)], names=["id", *result_names, "rest"]
            )

    out = state.where("data IS NULL").select("id", *result_names, "rest").unionByName(last.mapInArrow(finish, with_rest(f"id {kind}, {RESULT}")))
    dropped = ([] if with_text else ["kept_text"]) + ([] if carry else ["rest"])
    return out.drop(*dropped).withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their long repeats, with the columns of the input; those with nothing left go.

    A column ``n_chars`` is set to the new number of code points if the input has one.
    """
    found = long_repeats(docs, length, gram, id_col=id_col, text_col=text_col, with_text=True, carry=[c for c in docs.columns if c != text_col])
    new = {text_col: F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return found.where("kept_text <> ''").select(*[new.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])
