"""Exact cosine search in bounded blocks.

Vectors of a store are cut into blocks by a hash of their id. One unit of work is a
block of queries against a block of items: a small matrix product inside a task that
emits only its local winners. No task sees a whole store and no pair list is built.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MemoryConfig
from ..functions.vector import cosine
from ..session import lookup, materialize
from .groups import largest_group, map_groups, top_rows


#: Scores held at a time inside a task.
SLICE_CELLS = 4_000_000
PAIR_CELLS = 2_000_000  # numbers of the vectors of close pairs held at a time
#: A store is cut into no more blocks than these, so that the copies of a row stay as they are while tables grow; blocks grow
#: up to the given multiple of their configured size instead, and only then the copies do.
QUERY_BLOCKS, ITEM_BLOCKS, BLOCK_GROWTH = 64, 8, 32
KNN_BLOCKS = 64
#: The same where a store's vectors are all asked against all and every score is the result: blocks of queries and of items, and the rows of
#: a block from which on there are more of them. The result is written slice by slice, so a task holds little but the vectors.
PAIR_BLOCKS, PAIR_ROWS = (3, 2), 65_536


def lengths_of(col: pa.ChunkedArray) -> np.ndarray:
    """Vector lengths, -1 for a missing vector."""
    return pc.fill_null(pc.list_value_length(col), -1).to_numpy().astype(np.int64)


def to_matrix(col: pa.ChunkedArray, lengths: np.ndarray, dim: int) -> np.ndarray:
    """Rows whose length is ``dim``; every other row is zero and so scores zero."""
    flat = np.concatenate(
        [c.flatten().to_numpy(zero_copy_only=False) for c in col.chunks] or [np.empty(0)]
    ).astype(np.float64, copy=False)
    if (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim))
    ends = np.cumsum(np.maximum(lengths, 0))
    for i in np.flatnonzero(lengths == dim):
        out[i] = flat[ends[i] - dim : ends[i]]
    return out


def cosine_slices(a_col: pa.ChunkedArray, b_col: pa.ChunkedArray, cells: int = SLICE_CELLS) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of a's rows against all of b, a slice of about ``cells`` at a time, with the slice's first row."""
    a_len, b_len = lengths_of(a_col), lengths_of(b_col)
    sized = []
    for dim in np.unique(a_len[a_len > 0]):
        a, b = to_matrix(a_col, a_len, dim), to_matrix(b_col, b_len, dim)
        sized.append((dim, a, np.sqrt((a * a).sum(1)), b, np.sqrt((b * b).sum(1))))
    step = max(1, cells // max(1, len(b_len)))
    for at in range(0, len(a_len), step):
        scores = np.zeros((len(a_len[at : at + step]), len(b_len)))
        for dim, a, a_norm, b, b_norm in sized:
            rows = np.flatnonzero(a_len[at : at + step] == dim)
            product = a[at + rows] @ b.T
            scale = np.outer(a_norm[at + rows], b_norm)
            scores[rows] = np.divide(product, scale, out=np.zeros_like(product), where=scale > 0)
        yield at, scores


def close_pairs(
    a_col: pa.ChunkedArray, b_col: pa.ChunkedArray, threshold: float, cells: int = SLICE_CELLS
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs at or above ``threshold``, slice by slice of a's rows: first row, rows, and ascending (row in the slice, row of b, score).

    Unit vectors in single precision tell which pairs may reach the threshold, with a margin above the rounding error of their
    products; the scores of those alone are computed in double precision.
    """
    a_len, b_len = lengths_of(a_col), lengths_of(b_col)
    dims = np.unique(a_len[a_len > 0])
    margin = (max(dims, default=0) + 8) * 2.0**-23
    if threshold <= margin:  # pairs that score zero count too
        for at, scores in cosine_slices(a_col, b_col, cells):
            rows, cols = np.nonzero(scores >= threshold)
            yield at, len(scores), rows, cols, scores[rows, cols]
        return
    sized = []
    for dim in dims:
        sides = []
        for col, length in ((a_col, a_len), (b_col, b_len)):
            v = to_matrix(col, length, dim)
            norm = np.sqrt((v * v).sum(1))
            unit = np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] > 0).astype(np.float32)
            sides += [v, norm, unit]
        sized.append(sides)
    step = max(1, cells // max(1, len(b_len)))
    for at in range(0, len(a_len), step):
        n, parts = min(step, len(a_len) - at), []
        for a, a_norm, a_unit, b, b_norm, b_unit in sized:
            rows, cols = np.nonzero(a_unit[at : at + n] @ b_unit.T >= np.float32(threshold - margin))
            scores = np.empty(len(rows))
            for i in range(0, len(rows), PAIR_CELLS // a.shape[1] + 1):
                some = slice(i, i + PAIR_CELLS // a.shape[1] + 1)
                r, c = at + rows[some], cols[some]
                scores[some] = np.einsum("ij,ij->i", a[r], b[c]) / (a_norm[r] * b_norm[c])
            sure = scores >= threshold
            parts.append((rows[sure], cols[sure], scores[sure]))
        if len(parts) == 1:
            yield at, n, *parts[0]
        elif parts:  # a row has one length, so its pairs stay together
            rows, cols, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(rows, kind="stable")
            yield at, n, rows[order], cols[order], scores[order]


def cosine_matrix(a_col: pa.ChunkedArray, b_col: pa.ChunkedArray) -> np.ndarray:
    parts = [scores for _, scores in cosine_slices(a_col, b_col)]
    return np.concatenate(parts) if parts else np.zeros((0, len(b_col)))


def best_columns(scores: np.ndarray, seq: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` highest scores, equal scores in ``seq`` order."""
    if len(scores) > k:
        cut = -np.partition(-scores, k - 1)[k - 1]
        pool = np.flatnonzero(scores >= cut)
    else:
        pool = np.arange(len(scores))
    return pool[np.lexsort((seq[pool], -scores[pool]))[:k]]


def allowed_mask(qs: pa.Table, its: pa.Table, pairs: pa.Table) -> np.ndarray:
    """Which query may use which item, from (query, group) pairs."""
    ids = qs["query_id"].combine_chunks()
    groups = its["group_id"].combine_chunks().dictionary_encode()
    at_q = pc.index_in(pairs["query_id"], value_set=ids)
    at_g = pc.index_in(pairs["group_id"], value_set=groups.dictionary)
    both = pc.and_(pc.is_valid(at_q), pc.is_valid(at_g)).to_numpy(zero_copy_only=False)
    mask = np.zeros((len(ids), len(groups.dictionary)), dtype=bool)
    mask[pc.fill_null(at_q, 0).to_numpy()[both], pc.fill_null(at_g, 0).to_numpy()[both]] = True
    return mask[:, groups.indices.to_numpy()]


def _type_of(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def score_blocks(
    queries: DataFrame,
    items: DataFrame,
    keys: Sequence[str],
    k: int | None,
    config: MemoryConfig = DEFAULT,
    allowed: DataFrame | None = None,
    extremes: DataFrame | None = None,
    threshold: float | None = None,
    few: bool = False,
) -> DataFrame:
    """Score ``queries(keys, query_id, vec)`` against ``items(keys, item_id, seq, vec)``.

    With ``k`` each block pair returns its local top ``k`` rows plus the lowest and highest
    score in the block (``lo``, ``hi``); without it every score is returned, for callers
    whose result is one value per query and item. ``allowed(keys, query_id, group_id)``
    restricts a query to items of the named groups; ``items`` then carry ``group_id``, and
    the pairs travel to the block they concern. ``k=0`` returns one row per query and block with
    the extremes alone. With ``extremes(keys, query_id, lo, hi)`` scores are scaled to them where they are made.
    With ``threshold`` only scores of at least that leave a block that returns every score. With ``few`` a store is cut into
    ``PAIR_BLOCKS``, so that the copies of a vector do not grow with its store.
    """
    keys = list(keys)
    group = ["group_id"] if allowed is not None else []
    q = queries.select(*keys, "query_id", "vec").where(F.col("vec").isNotNull())
    ends = [] if extremes is None else ["lo", "hi"]
    if ends:
        q = q.join(extremes.select(*keys, "query_id", *ends), [*keys, "query_id"])
    it = items.select(*keys, "item_id", F.col("seq").cast("bigint").alias("seq"), "vec", *group)
    slot = group[0] if group else "item_id"

    def parts(n: str, other: str, block: int, most: int) -> Column:
        # a copy of each row of the other side per block, which is little where the other side is small
        mine = F.greatest(F.lit(most), F.ceil(F.col(n) / (PAIR_ROWS if few else BLOCK_GROWTH * block)), F.floor(F.col(n) / F.col(other)))
        return F.least(F.ceil(F.col(n) / block), mine).cast("bigint")

    # every score leaves its block, or every group is listed: small blocks
    most = PAIR_BLOCKS if few else (2**62, 2**62) if group or k is None else (QUERY_BLOCKS, ITEM_BLOCKS)
    blocks = lookup(
        q.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cq")).join(it.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ci")), keys)
        .select(*keys, parts("_cq", "_ci", config.query_block, most[0]).alias("_nq"), parts("_ci", "_cq", config.item_block, most[1]).alias("_ni"))
    )
    q_type, i_type = _type_of(q, "query_id"), _type_of(it, "item_id")
    vec_type = "array<double>" if "double" in (_type_of(q, "vec") + _type_of(it, "vec")) else "array<float>"
    q_side = q.join(blocks, keys).select(
        *keys,
        F.pmod(F.xxhash64("query_id"), F.col("_nq")).alias("_qb"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ni") - 1)).alias("_ib"),
        F.lit(0).alias("_side"),
        "query_id",
        F.lit(None).cast(i_type).alias("item_id"),
        F.lit(0).cast("bigint").alias("seq"),
        F.col("vec").cast(vec_type).alias("vec"),
        *[F.lit(None).cast(_type_of(it, c)).alias(c) for c in group],
        *ends,
    )
    i_side = it.join(blocks, keys).select(
        *keys,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nq") - 1)).alias("_qb"),
        F.pmod(F.xxhash64(slot), F.col("_ni")).alias("_ib"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(q_type).alias("query_id"),
        "item_id",
        "seq",
        F.col("vec").cast(vec_type).alias("vec"),
        *group,
        *[F.lit(None).cast("double").alias(c) for c in ends],
    )
    work = q_side.unionByName(i_side)
    if group:
        work = work.unionByName(
            allowed.join(blocks, keys).select(
                *keys, F.pmod(F.xxhash64("query_id"), F.col("_nq")).alias("_qb"),
                F.pmod(F.xxhash64(F.col(slot).cast(_type_of(it, slot))), F.col("_ni")).alias("_ib"), F.lit(2).alias("_side"),
                "query_id", F.lit(None).cast(i_type).alias("item_id"), F.lit(0).cast("bigint").alias("seq"),
                F.lit(None).cast(vec_type).alias("vec"), F.col(slot).cast(_type_of(it, slot)).alias(slot),
            )
        )
    key_schema = ", ".join(f"{c} {_type_of(q, c)}" for c in keys)
    schema = (
        f"{key_schema}, query_id {q_type}, item_id {i_type}, seq bigint, "
        "score double, lo double, hi double"
    )

    def kernel(t: pa.Table) -> Iterator[dict]:
        n_q = pc.sum(pc.equal(t["_side"], 0)).as_py() or 0
        n_i = pc.sum(pc.equal(t["_side"], 1)).as_py() or 0
        if n_q == 0 or n_i == 0:
            return
        qs, its = t.slice(0, n_q), t.slice(n_q, n_i)
        there = np.flatnonzero(lengths_of(its["vec"]) >= 0)
        mask = allowed_mask(qs, its, t.slice(n_q + n_i)) if group else None
        seq, ids = its["seq"].to_numpy(), its["item_id"].combine_chunks()
        names = {c: qs[c].combine_chunks() for c in [*keys, "query_id"]}
        low, high = (qs[c].to_numpy() for c in ends) if ends else (None, None)
        for at, scores in cosine_slices(qs["vec"], its["vec"]):
            n = len(scores)
            lo, hi = scores.min(1), scores.max(1)
            if ends:
                floor, span = low[at : at + n, None], (high - low)[at : at + n, None]
                scores = np.divide(scores - floor, span, out=np.zeros_like(scores), where=span != 0)
            if k == 0:
                rows, cols = np.arange(n), np.zeros(n, dtype=np.int64)
            elif k is None and threshold is not None:
                rows, cols = np.nonzero(scores >= threshold)
            elif k is None:
                rows = np.repeat(np.arange(n), n_i)
                cols = np.tile(np.arange(n_i), n)
            else:
                pools = [there] * n if mask is None else [there[m[there]] for m in mask[at : at + n]]
                picks = [p[best_columns(r[p], seq[p], k)] for r, p in zip(scores, pools)]
                rows = np.repeat(np.arange(n), [len(p) for p in picks])
                cols = np.concatenate(picks)
            result = {c: v.take(pa.array(at + rows)) for c, v in names.items()}
            result["item_id"] = ids.take(pa.array(cols))
            yield result | {"seq": seq[cols], "score": scores[rows, cols], "lo": lo[rows], "hi": hi[rows]}

    return map_groups(
        work, [*keys, "_qb", "_ib"], ["_side"], kernel, schema
    )


def top_k(
    queries: DataFrame, items: DataFrame, keys: Sequence[str], k: int, config: MemoryConfig = DEFAULT
) -> DataFrame:
    """Exact top ``k`` items per query, ties in ``seq`` order; adds ``rank``."""
    local = score_blocks(queries, items, keys, k, config).drop("lo", "hi")
    return top_rows(local, [*keys, "query_id"], [F.desc("score"), F.col("seq")], k)


def scaled_scores(
    queries: DataFrame, items: DataFrame, keys: Sequence[str], config: MemoryConfig = DEFAULT
) -> DataFrame:
    """Every item's score per query, scaled to [0,1] between the query's lowest and highest one: ``score``.

    Scores are computed twice, first for their extremes alone, so that no table of all pairs is shuffled or written.
    """
    ends = materialize(score_extremes(score_blocks(queries, items, keys, 0, config, few=True), keys))
    return score_blocks(queries, items, keys, None, config, extremes=ends, few=True).select(*keys, "query_id", "item_id", "score")


def score_extremes(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest and highest score per query from the block results."""
    return scored.groupBy(*keys, "query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _assign_blocks(items: DataFrame, keys: list[str], config: MemoryConfig) -> DataFrame:
    """Give each vector a block near a pivot, with its angle to that pivot.

    Pivots are the vectors whose id hash falls in one of as many slots as a block has rows, so there is
    about one per block. Cells above the block size are split again by hash. A block has ``knn_block`` rows, or more
    where a store would have over ``KNN_BLOCKS`` of them: the pairs of blocks and the copies of a row stay as they are then.
    """
    rows = F.greatest(F.lit(config.knn_block).cast("bigint"), F.ceil(F.count(F.lit(1)) / KNN_BLOCKS))
    sizes = lookup(items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), rows.alias("_rows")))
    sized = items.join(sizes, keys)
    small = sized.where(F.col("_n") <= config.knn_block).select(
        *items.columns, "_rows", F.lit(0).cast("bigint").alias("_cell"),
        F.lit(None).cast("double").alias("_angle"),
    )
    large = sized.where(F.col("_n") > config.knn_block).select(*items.columns, "_rows")
    pivots = large.where(F.pmod(F.xxhash64("item_id", F.lit(17)), F.col("_rows")) == 0).drop("_rows")
    near = top_k(
        large.select(*keys, F.col("item_id").alias("query_id"), "vec"), pivots, keys, 1, config
    ).select(
        *keys, F.col("query_id").alias("item_id"), F.col("seq").alias("_cell"),
        F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score"))).alias("_angle"),
    )
    # a store without a pivot keeps one cell; hashing below still bounds its blocks
    large = large.join(near, [*keys, "item_id"], "left").withColumn(
        "_cell", F.coalesce("_cell", F.lit(-1).cast("bigint"))
    )
    return small.unionByName(large.select(*small.columns))


def _block_pairs(base: DataFrame, keys: list[str], threshold: float, config: MemoryConfig) -> DataFrame:
    """Rows of both blocks of every block pair that may hold a match."""
    celled = _assign_blocks(base, keys, config)
    cell_sizes = celled.groupBy(*keys, "_cell").agg(
        F.ceil(F.count(F.lit(1)) / F.first("_rows")).alias("_parts")
    )
    placed = celled.join(cell_sizes, [*keys, "_cell"]).withColumn(
        "_block",
        F.struct("_cell", F.pmod(F.xxhash64("item_id", F.lit(29)), F.col("_parts")).alias("part")),
    )
    placed = materialize(placed)
    balls = placed.groupBy(*keys, "_block").agg(
        F.max("_angle").alias("radius"),
        F.max(F.col("_angle").isNull() | F.col("_angle").isNaN()).alias("open"),
    )
    pivots = base.select(*keys, F.col("seq").alias("_pivot"), F.col("vec").alias("center"))
    balls = balls.join(
        pivots, (F.col("_block._cell") == F.col("_pivot")) & _same(balls, pivots, keys), "left"
    ).select(*[balls[c] for c in keys], "_block", "radius", "open", "center")
    theta = math.acos(max(-1.0, min(1.0, threshold))) if threshold > 0 else math.pi
    left = balls.select(*keys, F.col("_block").alias("_a"), F.col("radius").alias("_ra"),
                        F.col("open").alias("_oa"), F.col("center").alias("_ca"))
    right = balls.select(*keys, F.col("_block").alias("_b"), F.col("radius").alias("_rb"),
                         F.col("open").alias("_ob"), F.col("center").alias("_cb"))
    gap = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("_ca"), F.col("_cb")))))
    near = F.coalesce(gap <= F.col("_ra") + F.col("_rb") + theta + 1e-6, F.lit(True))
    pairs = (
        left.join(right, keys)
        .where(F.col("_a") <= F.col("_b"))
        .where(F.col("_oa") | F.col("_ob") | (F.col("_a") == F.col("_b")) | near)
        .select(*keys, "_a", "_b")
    )
    members = placed.drop("_cell", "_angle", "_parts", "_rows")
    one = members.withColumnRenamed("_block", "_a").join(pairs, [*keys, "_a"]).withColumn("_side", F.lit(0))
    two = (
        members.withColumnRenamed("_block", "_b").join(pairs, [*keys, "_b"])
        .where(F.col("_a") != F.col("_b")).withColumn("_side", F.lit(1))
    )
    return one.unionByName(two).select(
        *keys, F.col("_a._cell").alias("_ac"), F.col("_a.part").alias("_ap"),
        F.col("_b._cell").alias("_bc"), F.col("_b.part").alias("_bp"),
        "_side", *base.columns[len(keys):],
    )


def knn_join(
    items: DataFrame,
    keys: Sequence[str],
    threshold: float,
    k: int | None,
    config: MemoryConfig = DEFAULT,
    over_time: bool = False,
) -> DataFrame:
    """Per item, its ``k`` most similar other items of the same store at or above ``threshold``.

    ``items(keys, item_id, seq, vec)`` with ``seq`` unique in a store. A block is a ball
    (pivot, radius); two blocks whose balls are further apart than the threshold angle
    cannot hold a match and are never compared. The triangle inequality makes this exact.
    ``k=None`` keeps every pair above the threshold. With ``over_time`` items also carry
    ``born`` and every neighbour returns that was among the best ``k`` at any time: when it
    and the item were both born, fewer than ``k`` better ones were.
    """
    keys = list(keys)
    extra = ["born"] if over_time else []
    base = items.select(*keys, "item_id", F.col("seq").cast("bigint").alias("seq"), "vec", *extra).where(
        F.col("vec").isNotNull()
    )
    if largest_group(base, keys) <= config.knn_block:
        work, unit = base.withColumn("_side", F.lit(0)), keys
    else:
        work, unit = _block_pairs(base, keys, threshold, config), [*keys, "_ac", "_ap", "_bc", "_bp"]
    id_type = _type_of(base, "item_id")
    key_schema = ", ".join(f"{c} {_type_of(base, c)}" for c in keys)
    schema = f"{key_schema}, query_id {id_type}, item_id {id_type}, query_seq bigint, seq bigint, score double"
    if over_time:
        schema += ", query_born bigint, born bigint"

    def kernel(t: pa.Table) -> Iterator[dict]:
        n_a = pc.sum(pc.equal(t["_side"], 0)).as_py() or 0
        a, b = t.slice(0, n_a), t.slice(n_a)
        if n_a == 0:
            return
        same = n_a == t.num_rows
        two = a if same else b
        for at, n, rows, cols, scores in close_pairs(a["vec"], two["vec"], threshold):
            part = a.slice(at, n)
            if same:
                other = rows + at != cols
                rows, cols, scores = rows[other], cols[other], scores[other]
            yield _local_hits(part, two, rows, cols, scores, k, keys, over_time)
            if not same:  # the same products seen from the other side
                order = np.argsort(cols, kind="stable")
                yield _local_hits(two, part, cols[order], rows[order], scores[order], k, keys, over_time)

    found = map_groups(work, unit, ["_side"], kernel, schema)
    if k is None or over_time:
        return found
    return top_rows(found, [*keys, "query_id"], [F.desc("score"), F.col("seq")], k)


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    cond = F.lit(True)
    for c in keys:
        cond = cond & (a[c] == b[c])
    return cond


def ever_best(scores: np.ndarray, seq: np.ndarray, born: np.ndarray, since: int, k: int) -> np.ndarray:
    """Positions that were among the best ``k`` at some time, for an item born at ``since``."""
    order = np.lexsort((seq, -scores))
    return order[_ever_best_ranked(born[order].tolist(), since, k)]


def _ever_best_ranked(born: list[int], since: int, k: int) -> list[int]:
    """The same for births in order of rank: kept is who came while fewer than ``k`` better ones were there."""
    if k <= 0:
        return []
    kept, better = list(range(min(k, len(born)))), sorted(born[:k])
    for i in range(k, len(born)):
        if better[-1] <= since:  # k better ones were there from the start
            break
        if born[i] < better[-1]:
            kept.append(i)
            insort(better, born[i])
            better.pop()
    return kept


def _local_hits(a, b, rows, cols, scores, k, keys, over_time=False) -> dict:
    """Of the pairs (row of a, row of b, score), in ascending order of rows, those that may be among the best ``k``."""
    born, since = (b["born"].to_numpy(), a["born"].to_numpy()) if over_time else (None, None)
    if k is not None and len(rows):
        seq = b["seq"].to_numpy()
        order = np.lexsort((seq[cols], -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
        size = np.diff(np.append(first, len(rows)))
        keep = np.arange(len(rows)) - np.repeat(first, size) < k
        for start, n in zip(first[size > k].tolist(), size[size > k].tolist(), strict=True) if over_time else ():
            births = born[cols[start : start + n]]
            if k and births[:k].max() > since[rows[start]]:
                keep[start + np.array(_ever_best_ranked(births.tolist(), int(since[rows[start]]), k))] = True
        rows, cols, scores = rows[keep], cols[keep], scores[keep]
    ra, ca = pa.array(rows, pa.int64()), pa.array(cols, pa.int64())
    out = {name: a[name].combine_chunks().take(ra) for name in keys}
    out["query_id"] = a["item_id"].combine_chunks().take(ra)
    out["item_id"] = b["item_id"].combine_chunks().take(ca)
    out["query_seq"] = a["seq"].combine_chunks().take(ra)
    out["seq"] = b["seq"].combine_chunks().take(ca)
    out["score"] = pa.array(scores)
    if over_time:
        out["query_born"], out["born"] = pa.array(since[rows]), pa.array(born[cols])
    return out
