"""Near duplicates by SuperMinHash signatures, banding, verification on full sets and union-find.

SuperMinHash gives element x the values r_j(x) + j at the places p_j(x) of a random permutation of the signature, and
the signature keeps the minimum at every place. Once the largest minimum is below j + 1, no later value can lower it, so
the levels j stop early: large sets need one or two. Minima do not depend on the order of elements, so all elements of a
set take a level together.

Equal sets are one class from the start. Classes that share a band are candidates; candidate clusters are found as
connected components of stars, never as pairs. Inside a cluster, signatures are compared in blocks, likely links between
different components are confirmed on the full shingle sets, and only a forest of confirmed links leaves the task.

A very long text is one set of hashes in the task that reads it (944 MB at the peak for 20 MB and 2.9 million words measured) and in each
one that confirms a link of it, which bounds the texts a worker can take. Equal hashes count as equal shingles. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramspark.llm.shared import settle
from engramspark.llm.winnowing import BASE, mix, powers

ROWS, BANDS = 4, 28  # a pair at 0.8 shares no band with probability (1 - 0.8^4)^28 < 4e-7
SIZE = ROWS * BANDS
LIKELY = 0.59  # share of equal signature places below which a pair at 0.8 lies by chance with probability < 1e-7
BLOCK = 4096  # classes compared in one task


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle; no words, none."""
    data = np.frombuffer(text.encode().lower(), dtype=np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(max(1 << 16, 1 << n.bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])])
    word = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(BASE))
    k = min(k, len(word))
    out = np.zeros(len(word) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(BASE) + word[i : i + len(out)] + np.uint64(i + 1))
    return np.unique(out)


def signature(elements: np.ndarray, size: int = SIZE) -> np.ndarray:
    """SuperMinHash: value (level << 32 | fraction) at every place. ``elements``: distinct 64-bit hashes, at least one."""
    best = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    n = len(elements)
    order = np.broadcast_to(np.arange(size, dtype=np.int16), (n, size))
    row = np.arange(n)
    for j in range(size):
        x = mix(elements + np.uint64((j + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((x >> np.uint64(32)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place = k
            if n >= 8 * size:  # often the only level: the permutations are made when the next one is needed
                first = k
            else:
                order = order.copy()
                order[row, k], order[:, 0] = 0, k
        else:
            if not order.flags.writeable:
                order = order.copy()
                order[row, first], order[:, 0] = 0, first
            place = order[row, k].copy()
            order[row, k], order[:, j] = order[:, j].copy(), place
        np.minimum.at(best, place, np.uint64(j << 32) | (x & np.uint64(0xFFFFFFFF)))
        if int(best.max()) >> 32 <= j:
            break
    return best


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different bands differ."""
    parts = sig.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(BASE)
    for i in range(ROWS):
        out = mix(out * np.uint64(BASE) + parts[:, i])
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """id, h, n_shingles, set_key (128 bits, null for empty sets), band keys. One pass, no shuffle."""

    def run(batches):
        import hashlib

        for b in batches:
            sizes, keys, rows = [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text or "", k)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                rows.append(bands(signature(s)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))],
                names=["id", "h", "n_shingles", "set_key", "bands"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, h bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b bigint): (node, root), root the smallest node. Nodes without edges are absent.

    Every round hooks a node to its smallest neighbour, if that is smaller, follows the hooks four steps, and renames the ends
    of the edges; edges inside a group vanish, so rounds shrink fast. The hooks of all rounds are composed in the end.
    """
    ends = edges.where("a <> b").selectExpr("least(a, b) AS lo", "greatest(a, b) AS hi").distinct()
    left, rounds = settle(ends), []
    while not left.isEmpty():
        hooks = left.groupBy("hi").agg(F.min("lo").alias("to"))
        for _ in range(2):
            further = hooks.selectExpr("hi AS to", "to AS far")
            hooks = settle(hooks.join(further, "to", "left").selectExpr("hi", "coalesce(far, to) AS to"))
        rounds.append(hooks)
        low, high = hooks.selectExpr("hi AS lo", "to AS low"), hooks.selectExpr("hi", "to AS high")
        renamed = left.join(low, "lo", "left").selectExpr("coalesce(low, lo) AS x", "hi").join(high, "hi").where("x <> high")
        left = settle(renamed.selectExpr("least(x, high) AS lo", "greatest(x, high) AS hi").distinct())
    labels = left.selectExpr("hi AS node", "lo AS root")
    for hooks in reversed(rounds):
        later = labels.selectExpr("node AS to", "root")
        mine = hooks.join(later, "to", "left").selectExpr("hi AS node", "coalesce(root, to) AS root")
        labels = settle(labels.join(mine, "node", "left_anti").unionByName(mine))
    return labels.unionByName(labels.selectExpr("root AS node", "root").distinct())


def verify_block(parts: list[int], sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Confirmed links (places in ``sets``) that connect the true components of the given classes.

    ``parts``: 0 or 1 for each set. If both occur, only links between the two parts are looked for.
    """
    n = len(sets)
    if n < 2:
        return
    part, sizes = np.array(parts), np.array([len(s) for s in sets])
    sigs = np.stack([signature(s) for s in sets])
    two, label = part.min() != part.max(), np.arange(n)
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        ok = (label[rest] != label[i]) & (np.minimum(sizes[rest], sizes[i]) * 100 >= percent * np.maximum(sizes[rest], sizes[i]))
        if two:
            ok &= part[rest] != part[i]
        rest = rest[ok]
        rest = rest[(sigs[rest] == sigs[i]).sum(axis=1) >= LIKELY * SIZE]
        for j in rest:
            if label[j] == label[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                label[label == label[j]] = label[i]
                yield i, int(j)


def links(members: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Confirmed links (a, b) inside candidate clusters. ``members``: node, cluster, n (classes of the cluster), text.

    A cluster within ``block`` classes is one task's group. A larger one is cut into blocks, and each pair of blocks is a
    group of its own: no group grows with the cluster, and every pair of classes meets in one.
    """
    count = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(F.col("own") <= o, 0).otherwise(1).alias("part")),
    )
    dealt = members.withColumns({"blocks": count, "own": own}).select("cluster", "node", "text", F.inline(pairs))

    def run(key, table):
        nodes, parts = table.column("node").to_pylist(), table.column("part").to_pylist()
        sets = [shingles(t or "", k) for t in table.column("text").to_pylist()]
        found = [(nodes[i], nodes[j]) for i, j in verify_block(parts, sets, percent)]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable over links), ``kept`` (first of its component).

    The first of a component has its smallest id, so ``kept`` is id = component_id as long as ids are unique.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of their sets of k-word shingles (ASCII lower case). Texts
    without words, empty and null ones are linked with nothing and are their own component. Documents with equal
    sets are linked. Of rows that share the smallest id, those with the smallest text hash are first; rows that repeat both id
    and text share their fate. Null ids come last: they are first only in components without any id, whose id is null.
    """
    return grouped(docs, k, percent, block, id_col, text_col).drop("h").withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without all but the first row of every component, with its columns. Repeated rows become one.

    Rows without words are their own components: all different ones stay.
    """
    kept = grouped(docs, k, percent, BLOCK, id_col, text_col).where("kept").select("id", "h").distinct()
    kept = kept.select(F.col("id").alias("kept_id"), F.col("h").alias("kept_h"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h"))
    both = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h")), "left_semi")
    return both.dropDuplicates(["id", "h"]).select("row.*")


def grouped(docs: DataFrame, k: int, percent: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """id, h (text hash), n_shingles, component_id, kept for every input row."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    rows = settle(sketches(source, k))
    full = rows.where("set_key IS NOT NULL")
    classes = settle(
        full.groupBy("set_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first"), F.min("bands").alias("bands"))
        .select("set_key", "first", F.col("first.id").alias("rep"), F.col("first.h").alias("h"), "bands", F.monotonically_increasing_id().alias("node"))
    )
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").select("band", "b")
    stars = banded.join(shared, "band").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    clusters = components(stars)
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    members = clusters.join(sizes, "root").join(classes.select("node", "rep", "h", "set_key"), "node")
    members = members.selectExpr("node", "root AS cluster", "n", "rep AS id", "h", "set_key")
    texts = with_texts(source, members, k)
    found = components(links(texts, k, percent, block))
    named = found.join(classes.select("node", "first"), "node")
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    linked = named.join(smallest, "root").select("node", "component")
    labels = classes.join(linked, "node", "left").select("set_key", F.coalesce("component", "first").alias("component"))
    out = rows.select("id", "h", "n_shingles", "set_key").join(labels, "set_key", "left")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    return out.withColumn("component", F.coalesce("component", own)).select(
        "id", "h", "n_shingles", F.col("component.id").alias("component_id"), own.eqNullSafe(F.col("component")).alias("kept")
    )


def with_texts(source: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """One text for each class in ``members`` (node, cluster, n, id, h, set_key): that of a row with this id, hash and set."""
    same_row = source["id"].eqNullSafe(members["id"]) & (source["h"] == members["h"])
    joined = source.join(members, same_row).select("node", "cluster", "n", "set_key", "text")

    def run(batches):
        import hashlib

        seen: set[int] = set()  # repeated rows of one class meet in one partition
        for b in batches:
            keep = []
            for node, key, text in zip(*(b.column(c).to_pylist() for c in (0, 3, 4)), strict=True):
                keep.append(node not in seen and hashlib.blake2b(shingles(text or "", k).tobytes(), digest_size=16).digest() == key)
                if keep[-1]:
                    seen.add(node)
            yield b.filter(pa.array(keep, pa.bool_())).select(["node", "cluster", "n", "text"])

    return joined.mapInArrow(run, "node bigint, cluster bigint, n bigint, text string")
