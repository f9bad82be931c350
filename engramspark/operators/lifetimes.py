"""What a memory of bounded capacity held after every flush.

A flush indexes a batch of passages of a store and then forgets down to capacity. Scores change with time, so which passages go
depends on all flushes before: `passage_lifetimes` replays them. Everything else has a closed form: an entity or a fact lives while
any passage that names it does (`islands`), and a later passage brings it back as a new node. A row is there after flush ``n`` if
``born <= n`` and it has no ``died`` or a later one; ``died`` is the flush whose forgetting removed it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, MemoryConfig
from ..functions.text import significant_name, triple_text
from ..session import materialize, ship_package
from .forgetting import HOUR_MS
from .graph import both_ways, entity_node
from .groups import map_groups, ordinals
from .ingest import ORD_BITS, entity_occurrences, occurrence_seq
from .similarity import score_blocks

FAR = (1 << 63) - 1
WINDOW = pa.struct([("edge", pa.int64()), ("above", pa.int64())])
SIZE_ROUNDS = 4  # shares of the keys whose lives are counted one after the other
PARTIAL = 50_000  # rows of one flush held before the lowest scores among them are taken


class Live:
    """The passages a store holds: positions, salience, times and accesses."""

    FIELDS = ("seq", "salience", "stored", "born", "accesses", "accessed")

    def __init__(self):
        self.rows = {f: np.empty(0, np.float64 if f == "salience" else np.int64) for f in self.FIELDS}

    def add(self, batch: dict[str, np.ndarray]) -> None:
        self.rows = {f: np.concatenate([self.rows[f], batch[f]]) for f in self.FIELDS}

    def access(self, seqs: np.ndarray, times: np.ndarray) -> None:
        """Accesses of passages not held are lost."""
        held = self.rows["seq"]
        order = np.argsort(held)
        at = np.searchsorted(held[order], seqs)
        known = at < len(held)
        known[known] = held[order[at[known]]] == seqs[known]
        rows = order[at[known]]
        np.add.at(self.rows["accesses"], rows, 1)
        np.maximum.at(self.rows["accessed"], rows, times[known])

    def forget(self, now: int, capacity: int) -> dict[str, np.ndarray]:
        """Drop the highest scores beyond ``capacity``; of equal ones the earlier goes."""
        r = self.rows
        if len(r["seq"]) <= capacity:
            return {f: v[:0] for f, v in r.items()}
        age = (float(now) - r["stored"]) / HOUR_MS
        recency = np.where(r["accesses"] > 0, 1.0 / (1.0 + (float(now) - r["accessed"]) / HOUR_MS), 0.0)
        score = (1.0 - r["salience"]) * np.log(1.0 + age) - recency
        order = np.lexsort((-r["seq"], score))
        kept, gone = np.sort(order[:capacity]), order[capacity:]
        lost = {f: v[gone] for f, v in r.items()}
        self.rows = {f: v[kept] for f, v in r.items()}
        return lost


def passage_lifetimes(
    passages: DataFrame, accesses: DataFrame | None = None, config: MemoryConfig = DEFAULT
) -> DataFrame:
    """``(store_id, passage_seq, born, died)`` of every passage.

    ``passages(store_id, flush, flush_ms, passage_seq, salience, timestamp_ms)``: ``flush_ms`` belongs to ``flush`` and grows with
    it, ``passage_seq`` is unique in its store. ``accesses(store_id, passage_seq, at_ms)`` count from their time on for passages
    then held. A forgetting depends on those before it, so a store is folded in order, as a stream of narrow rows: a
    task holds ``capacity`` passages and what one flush adds, of which only the ``capacity`` best are kept in between.
    """
    kind = passages.schema["store_id"].dataType.simpleString()
    rows = passages.select(
        "store_id", F.col("flush_ms").cast("bigint").alias("at"), F.lit(1).alias("stored"), F.col("passage_seq").cast("bigint").alias("seq"),
        F.col("flush").cast("bigint").alias("flush"), F.col("salience").cast("double").alias("salience"), F.col("timestamp_ms").cast("bigint").alias("since"),
    )
    if accesses is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("flush", "bigint"), ("salience", "double"), ("since", "bigint"))]
        rows = rows.unionByName(accesses.select("store_id", F.col("at_ms").cast("bigint").alias("at"), F.lit(0).alias("stored"), F.col("passage_seq").cast("bigint").alias("seq"), *none))
    capacity = config.max_passages
    ship_package(passages.sparkSession)

    def fold(batches) -> Iterator[pa.RecordBatch]:
        store, live, flush, now, held = object(), Live(), None, None, 0

        def out(ids: pa.DataType, lost: dict[str, np.ndarray], died: int | None) -> pa.RecordBatch:
            n = len(lost["seq"])
            return pa.RecordBatch.from_arrays(
                [pa.array([store] * n, ids), pa.array(lost["seq"]), pa.array(lost["born"]), pa.array([died] * n, pa.int64())], names=["store_id", "passage_seq", "born", "died"]
            )

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.schema.field("store_id").type
            stores, at, stored = b.column("store_id").to_pylist(), b.column("at").to_numpy(), b.column("stored").to_numpy()
            seq, flushes = b.column("seq").to_numpy(), b.column("flush").to_numpy(zero_copy_only=False)
            salience, since = (b.column(c).to_numpy(zero_copy_only=False) for c in ("salience", "since"))
            # runs of one store, time and kind
            first = [0] + [i for i in range(1, b.num_rows) if stores[i] != stores[i - 1] or at[i] != at[i - 1] or stored[i] != stored[i - 1]]
            for a, z in zip(first, [*first[1:], b.num_rows], strict=True):
                if now is not None and (stores[a] != store or at[a] != now):
                    yield out(ids, live.forget(now, capacity), flush)
                    now = None
                if stores[a] != store:
                    if held:
                        yield out(ids, live.rows, None)
                    store, live, held = stores[a], Live(), 1
                if not stored[a]:
                    live.access(seq[a:z], at[a:z])
                    continue
                flush, now, zeros = int(flushes[a]), int(at[a]), np.zeros(z - a, np.int64)
                live.add({"seq": seq[a:z], "salience": salience[a:z].astype(float), "stored": since[a:z].astype(np.int64), "born": np.full(z - a, flush), "accesses": zeros, "accessed": zeros})
                if len(live.rows["seq"]) > capacity + PARTIAL:
                    yield out(ids, live.forget(now, capacity), flush)
        if held:
            if now is not None:
                yield out(ids, live.forget(now, capacity), flush)
            yield out(ids, live.rows, None)

    placed = rows.repartition("store_id").sortWithinPartitions("store_id", "at", "stored", "seq")
    return placed.mapInArrow(fold, f"store_id {kind}, passage_seq bigint, born bigint, died bigint")


def islands(spans: DataFrame, keys: Sequence[str], first: str) -> DataFrame:
    """Union of the spans ``born..died`` of each key, with the smallest ``first`` of each part.

    A removal in the flush in which the next span begins leaves no gap: the batch is indexed before anything is forgotten. Spans
    of one birth are merged before the shuffle, so a key has at most as many rows as there are flushes.
    """
    keys = list(keys)
    merged = spans.groupBy(*keys, "born").agg(F.max(F.coalesce("died", F.lit(FAR))).alias("_end"), F.min(first).alias(first))
    w = Window.partitionBy(*keys).orderBy("born")
    apart = F.coalesce(F.col("born") > F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = merged.withColumn("_new", apart.cast("int")).withColumn("_part", F.sum("_new").over(w))
    parts = numbered.groupBy(*keys, "_part").agg(F.min("born").alias("born"), F.max("_end").alias("_end"), F.min(first).alias(first))
    return parts.select(*keys, "born", F.when(F.col("_end") < FAR, F.col("_end")).alias("died"), first)


def _spans(rows: DataFrame, lifetimes: DataFrame) -> DataFrame:
    return rows.join(lifetimes.select("store_id", "passage_seq", "born", "died"), ["store_id", "passage_seq"])


def entity_lifetimes(triples: DataFrame, lifetimes: DataFrame | None = None) -> DataFrame:
    """``(store_id, entity, born, died, seq)``: one row per life; ``seq`` orders first mentions.

    Without ``lifetimes`` the triples carry ``born`` and ``died`` of their passages, so that no row of theirs is moved to be joined.
    """
    if lifetimes is None:
        return islands(entity_occurrences(triples, "born", "died"), ["store_id", "entity"], "seq")
    seen = entity_occurrences(triples).groupBy("store_id", "passage_seq", "entity").agg(F.min("seq").alias("seq"))
    return islands(_spans(seen, lifetimes), ["store_id", "entity"], "seq")


def fact_lifetimes(triples: DataFrame, lifetimes: DataFrame | None = None) -> DataFrame:
    """``(store_id, fact, born, died, seq, owner_seq, subject, predicate, object)``: one row per life.

    The first passage of a life owns the fact and supplies its split. ``lifetimes`` as in ``entity_lifetimes``.
    """
    fact = triple_text(F.col("subject"), F.col("predicate"), F.col("object"))
    seq = F.col("passage_seq").cast("bigint")
    at = F.struct(occurrence_seq().alias("seq"), seq.alias("owner_seq"), "subject", "predicate", "object")
    if lifetimes is None:
        spans = triples.select("store_id", fact.alias("fact"), at.alias("at"), "born", "died")
    else:
        stated = triples.select("store_id", seq.alias("passage_seq"), fact.alias("fact"), at.alias("at"))
        spans = _spans(stated.groupBy("store_id", "passage_seq", "fact").agg(F.min("at").alias("at")), lifetimes)
    return islands(spans, ["store_id", "fact"], "at").select("store_id", "fact", "born", "died", "at.*")


def held(lives: DataFrame, flush: Column | int | None = None) -> DataFrame:
    """Rows that are there after ``flush``; None: after the last one."""
    if flush is None:
        return lives.where(F.col("died").isNull())
    at = flush if isinstance(flush, Column) else F.lit(flush)
    return lives.where((F.col("born") <= at) & (F.col("died").isNull() | (F.col("died") > at)))


def sizes(flushes: DataFrame, **lives: DataFrame) -> DataFrame:
    """Number of rows of each of ``lives`` after every flush of ``flushes(store_id, flush)``.

    Births and deaths are counted per flush before the running sum, which sees one row per flush. ``lives(store_id, key, born, died)``
    are counted table by table and in ``SIZE_ROUNDS`` shares of their keys, so that the shuffles of one share are there at a time.
    """
    changes = flushes.select("store_id", "flush").distinct().select("*", *[F.lit(0).cast("bigint").alias(n) for n in lives])
    for name, df in lives.items():
        steps = F.explode(F.array(F.struct(F.col("born").alias("flush"), F.lit(1).alias("n")), F.struct(F.col("died").alias("flush"), F.lit(-1).alias("n"))))
        for share in range(SIZE_ROUNDS):
            mine = df.where(F.pmod(F.xxhash64(df.columns[1]), F.lit(SIZE_ROUNDS)) == share)
            counted = mine.select("store_id", steps.alias("e")).where("e.flush IS NOT NULL").groupBy("store_id", F.col("e.flush").alias("flush")).agg(F.sum("e.n").alias(name))
            changes = changes.unionByName(materialize(counted), allowMissingColumns=True)
    per_flush = changes.groupBy("store_id", "flush").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in lives])
    w = Window.partitionBy("store_id").orderBy("flush")
    return per_flush.select("store_id", "flush", *[F.sum(n).over(w).alias(n) for n in lives])


def write_windows(since: np.ndarray, until: np.ndarray, own: int, k: int, wanted: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
    """For neighbours in order of rank: spans of passages in which each was among the best ``k`` of those alive, newest first.

    ``since`` and ``until`` bound lives in passages, both inside; ``own`` is the searching entity's birth. With ``wanted`` only the
    neighbours it marks get a list, the rest compete. A span may lie between
    two introductions, in which case nothing was written in it; the list ends with the first span that begins with one.
    """
    out: list[list[tuple[int, int]]] = []
    for i in range(len(since)) if wanted is None else np.flatnonzero(wanted).tolist():
        b, e = int(since[i]), int(until[i])
        low = max(own, b)
        births, ends = np.sort(since[:i]), np.sort(until[:i])
        edges = np.unique(np.concatenate([[low], births, ends[ends < FAR] + 1]))
        edges = edges[(edges >= low) & (edges <= e)]
        better = np.searchsorted(births, edges, side="right") - np.searchsorted(ends, edges, side="left")
        introduced = (edges == low) | np.isin(edges, births)
        spans, above = [], e
        for edge, n, sure in zip(edges[::-1].tolist(), better[::-1].tolist(), introduced[::-1].tolist(), strict=True):
            if n < k:
                spans.append((edge, above))
                if sure:
                    break
            above = edge - 1
        out.append(spans)
    return out


def removal_writes(
    entities: DataFrame, lives: DataFrame, lifetimes: DataFrame, config: MemoryConfig = DEFAULT
) -> DataFrame:
    """``(store_id, a, b, score, set_at)``: the last passage that wrote the similarity edge of two entities within their present lives."""
    k = config.synonymy_top_k
    # a life in passages: from its first one to the last one of the flush that ended it
    flush_ends = lifetimes.groupBy("store_id", F.col("born").alias("died")).agg(F.max("passage_seq").alias("last"))
    spans = materialize(
        lives.join(flush_ends, ["store_id", "died"], "left").select(
            "store_id", "entity", "seq", "born", F.shiftright("seq", ORD_BITS + 1).alias("since"), F.coalesce("last", F.lit(FAR)).alias("until")
        )
    )
    # only entities alive search, and a life that ended before the searching one's began competes with none of its writes
    items = entities.where(F.col("vec").isNotNull()).join(lives.groupBy("store_id", "entity").agg(F.min("seq").alias("seq")), ["store_id", "entity"])
    items = materialize(items.select("store_id", F.col("entity").alias("item_id"), "seq", "vec"))
    searching = spans.where(F.col("until") == FAR).select("store_id", F.col("entity").alias("a"), F.col("since").alias("own"))
    asking = items.join(searching.select("store_id", F.col("a").alias("item_id")), ["store_id", "item_id"], "left_semi")
    asking = asking.where(significant_name(F.col("item_id"))).select("store_id", F.col("item_id").alias("query_id"), "vec")
    pairs = score_blocks(asking, items, ["store_id"], None, config, threshold=config.synonymy_threshold)
    pairs = pairs.where(F.col("query_id") != F.col("item_id")).select("store_id", F.col("query_id").alias("a"), F.col("item_id").alias("b"), "score")
    found = pairs.join(searching, ["store_id", "a"]).join(
        spans.select("store_id", F.col("entity").alias("b"), "seq", "since", "until"), ["store_id", "b"]
    ).where(F.col("until") >= F.col("own"))

    def windows(t: pa.Table) -> dict:
        until = t["until"].to_numpy()
        present = pa.array(until == FAR)
        spans = write_windows(t["since"].to_numpy(), until, t["own"][0].as_py(), k, until == FAR)
        of = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int32), pa.array([x for y in spans for x in ({"edge": a, "above": z} for a, z in y)], WINDOW))
        return {c: t[c].combine_chunks().filter(present) for c in ("store_id", "a", "b", "score")} | {"windows": of}

    store = found.schema["store_id"].dataType.simpleString()
    asked = map_groups(
        found, ["store_id", "a"], [F.desc("score"), F.col("seq")], windows,
        f"store_id {store}, a string, b string, score double, windows array<struct<edge:bigint,above:bigint>>",
    ).select("store_id", "a", "b", "score", F.inline("windows"))

    # the last introduction up to a point: before every introduction, at every end of a flush, and now
    intros = spans.groupBy("store_id", "since").agg(F.min("born").alias("flush"))
    numbered = ordinals(intros.select("store_id", "since"), ["store_id"], ["since"], "n")
    before = numbered.select("store_id", (F.col("since") - 1).alias("above"), (F.col("n") - 1).alias("n")).join(
        numbered.select("store_id", "n", F.col("since").alias("at")), ["store_id", "n"]
    ).select("store_id", "above", "at")
    newest = intros.groupBy("store_id").agg(F.max("since").alias("at")).select("store_id", F.lit(FAR).alias("above"), "at")
    in_flush = flush_ends.join(intros.groupBy("store_id", F.col("flush").alias("died")).agg(F.max("since").alias("_in")), ["store_id", "died"], "left")
    running = F.max("_in").over(Window.partitionBy("store_id").orderBy("died"))
    at_ends = in_flush.select("store_id", F.col("last").alias("above"), running.alias("at")).where("at IS NOT NULL")
    points = before.unionByName(newest).unionByName(at_ends).groupBy("store_id", "above").agg(F.max("at").alias("at"))
    return (
        asked.join(points, ["store_id", "above"]).where(F.col("at") >= F.col("edge"))
        .groupBy("store_id", "a", "b").agg(F.max("score").alias("score"), F.max("at").alias("set_at"))
    )


def ledger_with_removals(
    triples: DataFrame, entities: DataFrame, lives: DataFrame, lifetimes: DataFrame, config: MemoryConfig = DEFAULT
) -> DataFrame:
    """Entity edges ``(store_id, src, dst, w)`` after the last flush, with all that forgetting took away.

    An edge is a sequence of events: a triple adds 1 (also one whose passage has gone since), a similarity edge is set anew whenever
    a passage introduces an entity while the neighbour is among the best ``k`` alive, and the death of either end resets it to
    nothing. Only what follows the last reset counts, the later birth of the two present lives; in it the last set overwrites and
    later triples add on top. ``entities(store_id, entity, vec)``, ``lives`` of entities and ``lifetimes`` of passages.
    """
    key = ["store_id", "src", "dst"]
    alive = held(lives).select("store_id", "entity", F.shiftright("seq", ORD_BITS + 1).alias("since"))
    ends = triples.select("store_id", F.col("subject").alias("s"), F.col("object").alias("o"), F.col("passage_seq").cast("bigint").alias("passage_seq"))
    for side in ("s", "o"):
        ends = ends.join(alive.select("store_id", F.col("entity").alias(side), F.col("since").alias(f"{side}_since")), ["store_id", side])
    named = [entity_node(F.col(side)).alias(side) for side in ("s", "o")]
    ends = ends.where(F.col("passage_seq") >= F.greatest("s_since", "o_since")).select("store_id", *named, "passage_seq")
    sets = removal_writes(entities, lives, lifetimes, config).select("store_id", *[entity_node(F.col(x)).alias(y) for x, y in (("a", "s"), ("b", "o"))], "score", "set_at")
    sets = both_ways(sets, "s", "o", "score", "set_at").groupBy(*key).agg(F.max("score").alias("_set"), F.max("set_at").alias("_at"))
    counted = both_ways(ends, "s", "o", "passage_seq").groupBy(*key, "passage_seq").agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.join(sets, key, "left").where(F.col("_at").isNull() | (F.col("passage_seq") > F.col("_at")))
    counted = counted.groupBy(*key).agg(F.sum("_n").cast("double").alias("_n"))
    return counted.join(sets, key, "full").select(*key, (F.coalesce("_set", F.lit(0.0)) + F.coalesce("_n", F.lit(0.0))).alias("w"))
