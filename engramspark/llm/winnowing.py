"""Document fingerprints by winnowing.

All k-grams of code points get a rolling polynomial hash modulo 2^64. In every window of w consecutive hashes the smallest is
chosen, the rightmost one if several are equal, and its position is kept. Two texts that share any passage of
w + k - 1 code points therefore share a chosen hash. Hashing and windows are array operations on one text at a time.

Texts are taken whole: hashes are made in blocks, and a text needs about 36 bytes per code point while it is windowed (714 MB for 20
million measured), which bounds the texts a worker can take. Equal hashes in a window: the rightmost. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramspark.llm.shared import settle

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
BLOCK = 1 << 18  # code points hashed at a time


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, dtype=np.uint64))]) for b in (BASE, inverse))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram; a text shorter than k is one gram."""
    n = len(codes)
    if n <= k:
        k = n
    if not n:
        return np.zeros(0, dtype=np.uint64)
    out = []
    up, down = powers(BLOCK + k)
    for at in range(0, n - k + 1, BLOCK):
        part = codes[at : at + BLOCK + k - 1].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)])])
        out.append(mix((sums[k:] - sums[:-k]) * down[: len(part) - k + 1]))
    return np.concatenate(out)


def winnow(hashes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Chosen (hashes, positions), positions ascending. Fewer than w hashes are one window."""
    n = len(hashes)
    if not n:
        return hashes, np.zeros(0, dtype=np.int64)
    w = min(w, n)
    best = np.arange(n)
    span = 1
    while span < w:  # best[i]: place of the minimum of span hashes from i on
        step = min(span, w - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(hashes[b] <= hashes[a], b, a)
        span += step
    chosen = best[np.concatenate([[True], best[1:] != best[:-1]])]
    return hashes[chosen], chosen


def fingerprint(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return winnow(gram_hashes(codes, k), w)


def as_set(hashes: np.ndarray) -> np.ndarray:
    """Distinct upper halves of chosen hashes, ascending: what the fingerprint string lists."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes given as sorted distinct arrays; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = 24, w: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_chars``, ``hashes`` (array of long) and ``positions`` (code points, ascending) as chosen.

    Null and empty texts have empty arrays. A text below k code points is one gram. No shuffle; repeated rows, null ids
    and further columns do no harm.
    """

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [fingerprint(t, k, w) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(map(len, texts), pa.int64()),
                    pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())),
                    pa.array([p for _, p in found], pa.list_(pa.int64())),
                ],
                names=["id", "n_chars", "hashes", "positions"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_chars bigint, hashes array<bigint>, positions array<bigint>"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many first code points of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_neighbours(docs: DataFrame, k: int = 24, w: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next text by ascending id (after the last: the first).

    Rows are range partitioned by id once and stream through sorted partitions; the last row of a partition meets the first
    row of the next one through a small table that has two rows per partition. Rows with equal ids follow each
    other in the order of a hash of their texts; null ids come first. A fingerprint string lists the distinct chosen hashes,
    ascending, as 8 hexadecimal digits each; it is empty for an empty text. Null texts count as empty. A single row is its own neighbour.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = source.schema["id"].dataType.simpleString()

    def rows(pairs) -> Iterator[tuple]:
        """(id, text, next text) to result rows."""
        known: tuple = (None, None)
        for id_, text, following in pairs:
            mine = known[1] if known[0] == text else as_set(fingerprint(text, k, w)[0])
            near = as_set(fingerprint(following, k, w)[0])
            new = edited(text, following)
            theirs = as_set(fingerprint(new, k, w)[0])
            known = (following, near)
            yield (
                id_, len(text), hashlib.sha256(new.encode()).hexdigest(), mine.astype(">u4").tobytes(), theirs.astype(">u4").tobytes(),
                likeness(mine, theirs), likeness(mine, near),
            )

    digest = pa.schema([
        ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])
    digest_sql = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def batch(found: list[tuple], ids: pa.DataType, edges: list[tuple] | None = None) -> pa.RecordBatch:
        """``edges``: (id, text, end) rows, end -1 for the first and 1 for the last row of a partition."""
        blank = (None,) * len(digest)
        full = [(*r, None, 0) for r in found] + [(e[0], *blank, e[1], e[2]) for e in edges or ()]
        columns = list(zip(*full, strict=True)) if full else [[]] * (len(digest) + 3)
        types = [ids, *digest.types, pa.string(), pa.int32()]
        names = ["id", *digest.names, "edge_text", "edge"]
        keep = len(types) if edges is not None else len(types) - 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], types[:keep], strict=True)], names=names[:keep])

    def inside(batches):
        last = ids = None
        for b in batches:
            ids, edges = b.schema.field(0).type, []
            queue = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            if not queue:
                continue
            if last is None:
                edges.append((*queue[0], -1))
            else:
                queue.insert(0, last)
            for at in range(0, len(queue) - 1, 500):
                part = [(*queue[i], queue[i + 1][1]) for i in range(at, min(at + 500, len(queue) - 1))]
                yield batch(list(rows(part)), ids, [])
            if edges:
                yield batch([], ids, edges)
            last = queue[-1]
        if last is not None:
            yield batch([], ids, [(*last, 1)])

    dealt = source.repartitionByRange("id", "h").sortWithinPartitions("id", "h")
    found = settle(dealt.mapInArrow(inside, f"id {kind}, {digest_sql}, edge_text string, edge int").withColumn("part", F.spark_partition_id()))
    edges = found.where("edge <> 0")
    # numbers of partitions that have rows, in order: bounded by the number of partitions, no texts
    order = Window.orderBy("part")
    parts = edges.where("edge = -1").select("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next_part"))
    heads = edges.where("edge = -1").select(F.col("part").alias("next_part"), F.col("edge_text").alias("next_text"))
    ends = edges.where("edge = 1").join(following, "part").join(heads, "next_part").select("id", "edge_text", "next_text")

    def across(batches):
        for b in batches:
            pairs = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield batch(list(rows(pairs)), b.schema.field(0).type)

    out = found.where("edge = 0").select("id", *digest.names).unionByName(ends.mapInArrow(across, f"id {kind}, {digest_sql}"))
    strings = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return out.withColumns(strings).withColumnRenamed("id", id_col)
