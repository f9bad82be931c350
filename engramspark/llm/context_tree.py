"""Language-model scoring by context-tree weighting.

The next byte is decided in eight binary steps, each a node below the last ``depth`` bytes. A node with n0 zeros and n1 ones has the
Krichevsky-Trofimov estimate Pe; weighting mixes it with what its deeper contexts say, Pw = (Pe + prod Pw(child)) / 2. With
the counts of the training texts fixed, a node's share of Pe in Pw tells how far a prediction stops at that depth, so
every (context, byte) pair has one probability that mixes all depths. Contexts that training never met predict like the
deepest one on their path that it met. A text ends with the byte 0xFF, which UTF-8 does not have, so text probabilities sum to one.

Texts are cut into chunks during the scan. A chunk sends its distinct words and byte grams with their counts, gets back what it
asked for, and scores its texts; no text is joined word by word, and no table is sent to all tasks. The tree is dealt out
by the last bytes of contexts: counts of chunks are merged in rounds, small shares are weighed bottom-up and predict top-down, the
few levels near the root lie in a Spark table between the two, and predictions meet the chunks' questions as a stream.

A very long text is a chunk of its own: its grams are arrays of several 8-byte numbers per byte while it is counted,
which bounds the texts a worker can take. Words and
grams have no order that could tie. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramspark.llm.shared import settle, slices

DEPTH = 5
SUFFIX = 3  # the tree is dealt out by the last bytes of contexts
PARTS = 512
CHUNK = 16 << 20  # bytes of text in a chunk
BLOCK = 2 << 20  # bytes of text whose grams are looked at together


@dataclass(frozen=True)
class Dealing:
    share: int = 50_000  # distinct keys weighed at a time
    fan: int = 32  # blobs of a part merged at a time
    salt: int = 512  # chunks that share one copy of a part's predictions


BEFORE, END = 0xFE, 0xFF  # bytes that UTF-8 does not have


def gram_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context << 8 | next byte) of all bytes and ends of the texts, and how many each text has."""
    pad = bytes([BEFORE]) * depth
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, bytes([END]))), dtype=np.uint8)
    key = np.zeros(len(data) - depth if len(data) else 0, dtype=np.int64)
    for i in range(depth + 1):
        key <<= 8
        key |= data[i : i + len(key)]
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    own = np.ones(len(key), dtype=bool)  # without the pads before a later text
    starts = np.cumsum(sizes + depth)[:-1] - depth
    for i in range(depth):
        own[starts + i] = False
    return key[own], sizes


def in_blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` bytes each, so that arrays of keys stay small."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def gram_counts(texts: list[bytes], learnt: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and how often the texts that are learnt from have them."""
    keys, counts = [], []
    for a, z in in_blocks(texts):
        key, sizes = gram_keys(texts[a:z], depth)
        codes, distinct = pd.factorize(key)
        keys.append(distinct)
        counts.append(np.bincount(codes, weights=np.repeat(np.array(learnt[a:z], dtype=np.float32), sizes), minlength=len(distinct)))
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    distinct, code = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(code, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """Compressed numbers: bytes of equal significance stand together."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, width).T.tobytes())


def unplanes(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def part_of(keys: np.ndarray, suffix: int, parts: int, bits: int = 40) -> np.ndarray:
    """Which part of the tree a key belongs to: a hash of the last ``suffix`` bytes of its context, its upper ``bits`` aside."""
    near = (keys >> 8 & (1 << 8 * suffix) - 1).astype(np.uint64)
    return (near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(bits) & np.uint64(0xFFFF)).astype(np.int64) % parts


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x >= 1/2: Stirling's series at x + 8."""
    y = x + 8
    low = functools.reduce(lambda a, b: a * b, [x + i for i in range(8)])
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


@dataclass
class Level:
    """Nodes of one depth: id (context << 8 | binary node) ascending, counts, ln Pw, share of Pe in Pw, place of each node's parent one depth up."""

    id: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    pw: np.ndarray
    stop: np.ndarray
    up: np.ndarray | None = None


def weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(ln Pw, share of Pe in Pw) of nodes with the summed ln Pw of their deeper contexts; None at the deepest."""
    pe = estimate(n0, n1)
    if below is None:
        return pe, np.ones(len(pe))
    return np.logaddexp(pe, below) - math.log(2), 1 / (1 + np.exp(np.minimum(below - pe, 700)))


class Tree:
    """The part of a context tree above some keys, from ``depth`` up to ``suffix``."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, suffix: int):
        byte, context = keys & 255, keys >> 8
        step = np.arange(8)[:, None]
        node = (1 << step) | (byte >> (8 - step))
        ids, self.at = np.unique((context << 8 | node).ravel(), return_inverse=True)
        self.bit = (byte >> (7 - step) & 1).astype(bool)
        ones, every = self.bit.ravel() * np.tile(counts, 8), np.tile(counts, 8)
        n1 = np.bincount(self.at, weights=ones, minlength=len(ids))
        n0 = np.bincount(self.at, weights=every, minlength=len(ids)) - n1
        self.levels = [Level(ids, n0, n1, *weigh(n0, n1, None))]
        for d in range(depth - 1, suffix - 1, -1):
            child = self.levels[-1]
            near = (child.id >> 8 & (1 << 8 * d) - 1) << 8 | child.id & 255
            ids, child.up = np.unique(near, return_inverse=True)
            n0, n1, below = (np.bincount(child.up, weights=v, minlength=len(ids)) for v in (child.n0, child.n1, child.pw))
            self.levels.append(Level(ids, n0, n1, *weigh(n0, n1, below)))

    def logs(self, mass: np.ndarray, rest: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """log10 probability of every key, given what has been mixed down to the top level (in its order)."""
        for level in self.levels[-2::-1]:
            one = (level.n1 + 0.5) / (level.n0 + level.n1 + 1)
            mass, rest, p1 = mass[level.up], rest[level.up], p1[level.up]
            p1 = np.where(level.n0 + level.n1 > 0, mass + rest * one, p1)
            mass, rest = mass + rest * level.stop * one, rest * (1 - level.stop)
        p = p1[self.at].reshape(8, -1)
        return np.log10(np.where(self.bit, p, 1 - p)).sum(axis=0)


def merged_grams(grams: DataFrame, suffix: int, chunks: int, dealing: Dealing) -> DataFrame:
    """Training counts of all chunks: (place, sub, data, more), one row per small share of the tree.

    A task merges about ``fan`` blobs of a part, over as many rounds as the number of chunks needs, so no group grows with the corpus;
    in the end a part is split by the same suffixes until a share has about ``share`` distinct keys.
    """

    def merge(table: pa.Table, last: bool) -> pa.Table:
        keys = [np.cumsum(unplanes(b, "<i8")) for b in table.column("data").to_pylist()]
        counts = [unplanes(b, "<u8") for b in table.column("more").to_pylist()]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(counts).astype(float), minlength=len(distinct)).astype("<u8")
        place, slot = (table.column(c)[0].as_py() for c in ("place", "slot"))
        subs = part_of(distinct, suffix, -(-len(distinct) // dealing.share) if last else 1, 24)
        order = np.argsort(subs, kind="stable")
        names, starts = np.unique(subs[order], return_index=True)
        groups = np.split(order, starts[1:])
        return pa.table({
            "place": pa.array([place] * len(groups), pa.int64()), "slot": pa.array(names if last else [slot], pa.int64()),
            "data": pa.array([planes(np.diff(distinct[g], prepend=0)) for g in groups], pa.binary()), "more": pa.array([planes(n[g]) for g in groups], pa.binary()),
        })

    def merging(last: bool):
        return lambda table: merge(table, last)

    schema, rows, left = "place bigint, slot bigint, data binary, more binary", grams.withColumn("slot", F.xxhash64("t")), chunks
    while True:
        left = -(-left // dealing.fan)
        slots = rows.select("place", F.pmod("slot", F.lit(max(left, 1))).alias("slot"), "data", "more")
        last = left <= 1
        rows = slots.groupBy("place", "slot").applyInArrow(merging(last), schema)
        if last:
            return settle(rows.withColumnRenamed("slot", "sub"))


def predictions(grams: DataFrame, depth: int, suffix: int, chunks: int, dealing: Dealing) -> DataFrame:
    """``grams`` (t, place: part of the tree, data: keys, more: training counts) to (t, place, data: log10 probabilities, same order).

    Shares of the tree weigh their nodes up to ``suffix``; from there to the root the tree is a table of Spark, bounded by the alphabet;
    on the way down the shares take over again. What they predict is laid beside the chunks' keys, part by part, as a stream.
    """

    def grown(data: bytes, more: bytes) -> tuple[np.ndarray, Tree]:
        keys = np.cumsum(unplanes(data, "<i8"))
        return keys, Tree(keys, unplanes(more, "<u8").astype(float), depth, suffix)

    def weights(batches):
        for b in batches:
            for place, sub, data, more in zip(*(b.column(c) for c in ("place", "sub", "data", "more")), strict=True):
                top = grown(data.as_py(), more.as_py())[1].levels[-1]
                n = len(top.id)
                columns = (top.id >> 8, top.id & 255, top.n0, top.n1, top.pw, top.stop, np.full(n, place.as_py()), np.full(n, sub.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["context", "node", "n0", "n1", "pw", "stop", "place", "sub"])

    shares = merged_grams(grams, suffix, chunks, dealing)
    columns = "context bigint, node bigint, n0 double, n1 double, pw double, stop double"
    levels = [settle(shares.mapInArrow(weights, f"{columns}, place bigint, sub bigint"))]

    def lighter(batches):
        for b in batches:
            n0, n1, below = (b.column(i).to_numpy() for i in (2, 3, 4))
            pw, stop = weigh(n0, n1, below)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(pw), pa.array(stop)], names=["context", "node", "n0", "n1", "pw", "stop"])

    for d in range(suffix - 1, -1, -1):
        near = F.expr(f"context & {(1 << 8 * d) - 1}L").alias("context")
        sums = levels[-1].groupBy(near, "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below"))
        levels.append(settle(sums.mapInArrow(lighter, columns)))
    one, met = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1), F.col("n0") + F.col("n1") > 0
    path = levels[-1].select("context", "node", (F.col("stop") * one).alias("mass"), (1 - F.col("stop")).alias("rest"), one.alias("p1"))
    for d in range(1, suffix + 1):
        above = path.selectExpr("context AS up", "node", "mass", "rest", "p1")
        here = levels[suffix - d].withColumn("up", F.expr(f"context & {(1 << 8 * (d - 1)) - 1}L")).join(above, ["up", "node"])
        path = here.select(
            "context", "node", (F.col("mass") + F.col("rest") * F.col("stop") * one).alias("mass"), (F.col("rest") * (1 - F.col("stop"))).alias("rest"),
            F.when(met, F.col("mass") + F.col("rest") * one).otherwise(F.col("p1")).alias("p1"), *(["place", "sub"] if d == suffix else []),
        )

    def predicted(left: pa.Table, right: pa.Table) -> pa.Table:
        tree = grown(left.column("data")[0].as_py(), left.column("more")[0].as_py())[1]
        context, node, mass, rest, p1 = (right.column(c).to_numpy() for c in ("context", "node", "mass", "rest", "p1"))
        order = np.argsort(context << 8 | node)
        logs = planes(tree.logs(mass[order], rest[order], p1[order]).astype("<f4"))
        return pa.table({"place": left.column("place"), "keys": left.column("data"), "logs": pa.array([logs], pa.binary())})

    known = shares.groupBy("place", "sub").cogroup(path.groupBy("place", "sub")).applyInArrow(predicted, "place bigint, keys binary, logs binary")
    salts = max(1, -(-chunks // dealing.salt))
    copies = known.select("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"), F.lit(None).cast("bigint").alias("t"), "keys", "logs")
    asked = grams.select("place", F.pmod(F.xxhash64("t"), F.lit(salts)).cast("bigint").alias("salt"), "t", F.col("data").alias("keys"), F.lit(None).cast("binary").alias("logs"))

    def answers(batches):
        """Rows of a part: first what the tree predicts, then what the chunks ask."""
        place, shares_of, keys, logs = None, [], None, None
        for b in batches:
            out: list[tuple] = []
            for i in range(b.num_rows):
                at, t, data, values = (b.column(c)[i].as_py() for c in ("place", "t", "keys", "logs"))
                if t is None:
                    if keys is not None or at != place:
                        place, shares_of, keys = at, [], None
                    shares_of.append((np.cumsum(unplanes(data, "<i8")), unplanes(values, "<f4")))
                    continue
                if keys is None:
                    keys, logs = (np.concatenate([s[j] for s in shares_of]) for j in (0, 1))
                    order = np.argsort(keys)
                    keys, logs, shares_of = keys[order], logs[order], []
                out.append((t, at, planes(logs[np.searchsorted(keys, np.cumsum(unplanes(data, "<i8")))])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["t", "place", "data"])

    dealt = copies.unionByName(asked).repartition("place", "salt").sortWithinPartitions("place", "salt", F.col("t").isNotNull())
    return dealt.mapInArrow(answers, "t bigint, place bigint, data binary")


def requests(source: DataFrame, depth: int, suffix: int, parts: int, chunk: int) -> DataFrame:
    """Per chunk t: its texts (kind 0), distinct words in order with training counts (1; the end of a text is the empty word), and
    for every part of the tree the chunk's distinct keys in order with training counts (2).
    """
    kind = source.schema["id"].dataType.simpleString()

    def cut(batches):
        held: list[tuple] = []
        size = number = 0
        part = TaskContext.get().partitionId()
        for b in slices(batches):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = (row[2] or "").encode()
                held.append((row[0], row[1], text))
                size += len(text)
                if size >= chunk:
                    yield from emit(part << 32 | number, held, b.schema.field(0).type)
                    held, size, number = [], 0, number + 1
        if held:
            yield from emit(part << 32 | number, held, b.schema.field(0).type)

    def emit(t, held, ids):
        for rows in columns(held):
            n = len(rows[4])
            kinds = (pa.int64(), ids, pa.bool_(), pa.binary(), pa.binary(), pa.int64())
            full = [pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(rows[1:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, t)), pa.array(np.full(n, rows[0], dtype=np.int32)), *full],
                names=["t", "kind", "place", "id", "held_out", "data", "more", "n"],
            )

    def columns(held):
        """The chunk's rows kind by kind, so that words are gone when grams are counted."""
        texts = [x[2] for x in held]
        yield 0, None, [x[0] for x in held], [x[1] for x in held], list(map(zstandard.ZstdCompressor(level=1).compress, texts)), None, None
        train, every = Counter(), {b""}
        for _, out, text in held:
            (every if out else train).update(text.lower().split())
        train[b""] += sum(not x[1] for x in held)
        words = sorted(every | train.keys())
        yield 1, np.arange(len(words)), None, None, words, None, [train[w] for w in words]
        del train, every, words
        keys, counts = gram_counts(texts, [not x[1] for x in held], depth)
        part = part_of(keys, suffix, parts)
        order = np.argsort(part, kind="stable")
        places, starts = np.unique(part[order], return_index=True)
        groups = np.split(order, starts[1:])
        yield 2, places, None, None, [planes(np.diff(keys[g], prepend=0)) for g in groups], [planes(counts[g].astype("<u8")) for g in groups], None

    return source.mapInArrow(cut, f"t bigint, kind int, place bigint, id {kind}, held_out boolean, data binary, more binary, n bigint")


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, chunk: int = CHUNK, parts: int = PARTS, id_col: str = "doc_id", text_col: str = "text", dealing: Dealing = Dealing()) -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    The model learns from the texts for which ``held_out`` is not true, all of them and whole; ``score`` is its log10 probability of
    the text and its end. ``base_score`` is that of single words (ASCII lower case, runs without ASCII white space, one end),
    each with 0.1 added to its training count. Null texts are empty: one token, the end. ``bits_per_byte`` counts the end
    as a byte. Without training texts every estimate is that of zero counts. Repeated rows are scored, and learnt,
    as often as they come; null ids and further columns do no harm.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    suffix = min(SUFFIX, depth)
    asked = settle(requests(source, depth, suffix, parts, chunk))
    word = Window.partitionBy("data")
    words = settle(asked.where("kind = 1").select("t", "place", "n", F.sum("n").over(word).alias("c"), F.count(F.lit(1)).over(word).alias("chunks")))
    total, distinct = words.agg(F.sum("n"), F.round(F.sum(F.when(F.col("c") > 0, 1 / F.col("chunks"))))).first()
    total, distinct = int(total or 0), int(distinct or 0)
    chunks = asked.where("kind = 1").select("t").distinct().count()
    grams = predictions(asked.where("kind = 2").select("t", "place", "data", "more"), depth, suffix, chunks, dealing)
    # a word that no other chunk has is counted in its own
    answers = words.where("chunks > 1").select("t", "place", F.col("c").cast("double").alias("c"), F.lit(None).cast("binary").alias("data")).unionByName(
        grams.select("t", "place", F.lit(None).cast("double").alias("c"), "data")
    )
    texts = asked.where("kind = 0").select("t", "id", "held_out", "data")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        data = [unpack(x) for x in left.column("data").to_pylist()]
        learnt = [not x for x in left.column("held_out").to_pylist()]
        is_word = pc.is_valid(right.column("c"))
        shared, parted = right.filter(is_word), right.filter(pc.invert(is_word))
        train, every = Counter(), {b""}
        for text, own in zip(data, learnt, strict=True):
            (train if own else every).update(text.lower().split())
        vocabulary = sorted(every | train.keys())
        counts = np.fromiter(map(train.__getitem__, vocabulary), dtype=float, count=len(vocabulary))
        counts[0] = sum(learnt)  # the end of a text
        counts[shared.column("place").to_numpy()] = shared.column("c").to_numpy()
        rate, known = np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1))), counts > 0
        at = dict(zip(vocabulary, range(len(vocabulary)), strict=True)).__getitem__
        n_tokens, n_known, base = [], [], []
        for text in data:
            words_of = text.lower().split()
            i = np.fromiter(map(at, words_of), dtype=np.int64, count=len(words_of))
            n_tokens.append(len(i) + 1)
            n_known.append(int(known[i].sum() + known[0]))
            base.append(float(rate[i].sum() + rate[0]))
        del train, every, vocabulary, at
        blocks = []
        for a, z in in_blocks(data):
            key, size = gram_keys(data[a:z], depth)
            codes, own = pd.factorize(key)
            blocks.append((codes.astype(np.int32), own, size))
        keys = np.unique(np.concatenate([own for _, own, _ in blocks]))
        logs, part = np.empty(len(keys)), part_of(keys, suffix, parts)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        for place, blob in zip(parted.column("place").to_pylist(), parted.column("data").to_pylist(), strict=True):
            logs[order[ends[place] : ends[place + 1]]] = unplanes(blob, "<f4")
        sums = [np.add.reduceat(logs[np.searchsorted(keys, own)][codes], np.cumsum(size) - size) for codes, own, size in blocks]
        sizes = [size for _, _, size in blocks]
        sums, sizes, n = np.concatenate(sums), np.concatenate(sizes), len(data)
        return pa.table({
            "id": left.column("id"), "held_out": left.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([total] * n, pa.int64()), "base_score": pa.array(base, pa.float64()),
            "score": pa.array(sums), "bits_per_byte": pa.array(-sums / math.log10(2) / sizes),
        })

    schema = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return texts.groupBy("t").cogroup(answers.groupBy("t")).applyInArrow(run, schema).withColumnRenamed("id", id_col)
