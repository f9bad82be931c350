"""Ranked lexical search over posting lists blocked by document similarity.

Terms are numbered from the rarest to the commonest. Documents are brought into an order in which similar ones stand together (nearest
and second nearest of a few leader documents) and cut into chunks. In a chunk each term's posting list is cut into blocks of
neighbours; a block stores the coordinatewise maximum of its documents' impacts, over the terms that stand in one query with the
block's term and are not rarer than it. A document belongs to its rarest term of a query, so no document that still has to be found
in a block can score more than the block's maxima weighted by the query: a block is skipped only if this exact bound is
below the score of the last of the ten best found so far. The documents of other blocks are scored in full.

Search is exact. The leaders are the only sample (``leaders`` documents); they shape the blocks and cannot change a result.
Queries are read in batches of about ``batch_bytes`` of text, for which an index is made and shared by all tasks; every batch meets
all documents, chunk by chunk, and a task hands on its ten best per query.

Defined results: null and empty texts have no terms and are in no result; a query without terms, or whose terms no document
has, gives no rows; equal scores go to the smaller document id, null first; repeated document rows are documents of their own, repeated
query rows give repeated results; empty tables give empty results; further columns are ignored. A text is held whole by its task, as
bytes and terms; the index holds distinct query terms only.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramspark.llm.shared import settle, slices

#: Maximal runs of characters that are no ASCII punctuation, space or control; in UTF-8 every byte from 0x80 on belongs to one.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
CHUNK = 512
BLOCK = 32
SCALE = 1_000_000_000


def terms(text: str | None) -> list[bytes]:
    """Terms in order; ``bytes.lower`` changes A-Z only."""
    return TERM.findall((text or "").encode().lower())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Queries:
    """A batch of queries over numbered terms."""

    def __init__(self, rows: list[tuple], df: dict[bytes, int], n_docs: int):
        self.keys = [k for k, _ in rows]
        counts = [Counter(terms(t)) for _, t in rows]
        self.names = sorted({t for c in counts for t in c if df.get(t)}, key=lambda t: (df[t], t))  # rarest first
        number = {t: i for i, t in enumerate(self.names)}
        weights = np.array([weight(n_docs, df[t]) for t in self.names], np.int64)
        self.terms, self.weights = [], []
        for c in counts:
            ids = np.array(sorted(number[t] for t in c if t in number), np.int64)
            self.terms.append(ids)
            self.weights.append(np.array([c[self.names[i]] for i in ids], np.int64) * weights[ids])
        together: list[set[int]] = [set() for _ in self.names]
        for ids in self.terms:
            for at, t in enumerate(ids):
                together[t].update(ids[at:].tolist())
        #: Per term the terms not rarer than it that share a query with it.
        self.together = [np.array(sorted(s), np.int32) for s in together]


def impacts(tf: np.ndarray, n: int, n_docs: int, all_terms: int) -> np.ndarray:
    """A document's share of the score, before the term's weight."""
    m = 100 - 75 + (75 * n * n_docs) // all_terms
    return (SCALE * tf) // (1000 * tf + 8 * m)


INDEX = pa.schema(
    [("docs", pa.list_(pa.int32())), ("doc_terms", pa.list_(pa.int32())), ("doc_impacts", pa.list_(pa.int32()))]
    + [(n, pa.list_(pa.int32())) for n in ("block_term", "block_ends", "block_docs", "max_ends", "max_terms", "max_impacts")]
)
INDEX_SQL = ", ".join(f"{n} array<int>" for n in INDEX.names)


def index_chunk(rows: list[tuple[np.ndarray, np.ndarray]], together: list[np.ndarray]) -> list[np.ndarray]:
    """The columns of INDEX for documents (terms, impacts) in geometric order; ``docs`` are the ends of the documents' terms."""
    ends = np.cumsum([len(t) for t, _ in rows])
    flat, values = (np.concatenate([r[i] for r in rows]).astype(np.int64) for i in (0, 1))
    of = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0))
    here, local = np.unique(flat, return_inverse=True)
    dense = np.zeros((len(rows), len(here)), np.int32)
    dense[of, local] = values
    order = np.argsort(local, kind="stable")
    by_term, starts = of[order], np.searchsorted(local[order], np.arange(len(here) + 1))
    block_term, block_ends, max_ends, max_terms, max_impacts, total = [], [], [], [], [], 0
    for i, t in enumerate(here.tolist()):
        docs = by_term[starts[i] : starts[i + 1]]
        columns = np.searchsorted(here, together[t])
        columns = columns[(columns < len(here)) & (here[np.minimum(columns, len(here) - 1)] == together[t])]
        cuts = np.arange(0, len(docs), BLOCK)
        best = np.maximum.reduceat(dense[np.ix_(docs, columns)], cuts, axis=0)
        row, column = np.nonzero(best)
        block_term.append(np.full(len(cuts), t))
        block_ends.append(starts[i] + np.minimum(cuts + BLOCK, len(docs)))
        max_ends.append(total + np.cumsum(np.bincount(row, minlength=len(cuts))))
        max_terms.append(here[columns[column]])
        max_impacts.append(best[row, column])
        total += len(row)
    return [ends, flat, values, *(np.concatenate(x) for x in (block_term, block_ends)), by_term, *(np.concatenate(x) for x in (max_ends, max_terms, max_impacts))]


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """starts[0]..ends[0], starts[1]..ends[1], ... in one array; no range is empty."""
    sizes = ends - starts
    out = np.ones(sizes.sum(), np.int64)
    out[0] = starts[0]
    out[np.cumsum(sizes)[:-1]] = starts[1:] - ends[:-1] + 1
    return np.cumsum(out)


class Best:
    """The ``k`` best (score, id) of a query so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        """A document must reach this score."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        more = [(-int(s), i is not None, i) for s, i in zip(scores.tolist(), ids, strict=True) if s >= self.floor]
        if more:
            self.rows = heapq.nsmallest(self.k, self.rows + more, key=lambda r: r if r[1] else (r[0], False, 0))


def search_chunk(ids: list, chunk: dict[str, np.ndarray], queries: Queries, best: list[Best]) -> int:
    """Bring all queries' best up to date with a chunk; returns the number of documents scored."""
    doc_ends, flat, values = chunk["docs"], chunk["doc_terms"], chunk["doc_impacts"]
    doc_starts = np.concatenate([[0], doc_ends[:-1]])
    block_starts = np.concatenate([[0], chunk["block_ends"][:-1]])
    max_starts = np.concatenate([[0], chunk["max_ends"][:-1]])
    here, first = np.unique(chunk["block_term"], return_index=True)
    last = np.concatenate([first[1:], [len(chunk["block_term"])]])
    weights, scored = np.zeros(len(queries.names), np.int64), 0
    for q, (q_terms, q_weights) in enumerate(zip(queries.terms, queries.weights, strict=True)):
        at = np.searchsorted(here, q_terms)
        at = at[(at < len(here)) & (here[np.minimum(at, len(here) - 1)] == q_terms)]
        if not at.size:
            continue
        weights[q_terms] = q_weights
        blocks = ranges(first[at], last[at])
        entries = ranges(max_starts[blocks], chunk["max_ends"][blocks])
        bounds = np.add.reduceat(chunk["max_impacts"][entries] * weights[chunk["max_terms"][entries]], np.concatenate([[0], np.cumsum(chunk["max_ends"][blocks] - max_starts[blocks])[:-1]]))
        order, done, seen = np.argsort(-bounds, kind="stable"), 0, np.zeros(len(ids), bool)
        while done < len(order) and bounds[order[done]] >= best[q].floor:
            some = order[done : done + (2 if not done else 16)]
            done += len(some)
            some = blocks[some[bounds[some] >= best[q].floor]]
            docs = np.unique(chunk["block_docs"][ranges(block_starts[some], chunk["block_ends"][some])])
            docs = docs[~seen[docs]]
            if docs.size:
                seen[docs] = True
                scored += len(docs)
                entries = ranges(doc_starts[docs], doc_ends[docs])
                scores = np.add.reduceat(values[entries] * weights[flat[entries]], np.concatenate([[0], np.cumsum(doc_ends[docs] - doc_starts[docs])[:-1]]))
                best[q].add(scores, [ids[d] for d in docs])
        weights[q_terms] = 0
    return scored


def occurrences(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Per document its id, its number of terms, and the vocabulary terms in it with their numbers of occurrences."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def read(batches):
        for b in slices(batches, 500):
            sizes, found, counts = [], [], []
            for text in b.column(1).to_pylist():
                mine = terms(text)
                sizes.append(len(mine))
                seen = sorted((number[t], n) for t, n in Counter(mine).items() if t in number)
                found.append([t for t, _ in seen])
                counts.append([n for _, n in seen])
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "tf"])

    kind = docs.schema["id"].dataType.simpleString()
    return settle(docs.mapInArrow(read, f"id {kind}, n bigint, terms array<int>, tf array<int>"))


def geometric(found: DataFrame, renumber: np.ndarray, leaders: int, n_weights: np.ndarray) -> DataFrame:
    """Rows with terms, in partitions ordered by the nearest and second nearest leader; terms by their new numbers."""
    picked = found.where(F.size("terms") > 0).orderBy(F.xxhash64("id", "terms"), "id").limit(leaders).select("terms", "tf").collect()
    shape = np.zeros((len(n_weights), max(len(picked), 2)), np.float32)
    for i, (t, tf) in enumerate(picked):
        shape[renumber[t], i] = n_weights[renumber[t]] * (1 + np.log(tf))
    shape /= np.maximum(np.sqrt((shape**2).sum(0)), 1e-9)

    def read(batches):
        for b in slices(batches, 2000):
            near, new_terms, new_tf = [], [], []
            for t, tf in zip(b.column("terms").to_pylist(), b.column("tf").to_pylist(), strict=True):
                t, tf = renumber[t], np.array(tf, np.int64)
                order = np.argsort(t)
                t, tf = t[order], tf[order]
                like = (n_weights[t] * (1 + np.log(tf))).astype(np.float32) @ shape[t]
                a, c = np.argpartition(-like, 1)[:2]
                near.append((int(a), int(c)) if like[a] >= like[c] else (int(c), int(a)))
                new_terms.append(t)
                new_tf.append(tf)
            columns = [b.column("id"), b.column("n"), pa.array(new_terms, pa.list_(pa.int32())), pa.array(new_tf, pa.list_(pa.int32())), *(pa.array([x[i] for x in near], pa.int32()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "tf", "near", "next"])

    kind = found.schema["id"].dataType.simpleString()
    rows = found.where(F.size("terms") > 0).mapInArrow(read, f"id {kind}, n bigint, terms array<int>, tf array<int>, near int, next int")
    return rows.repartitionByRange("near", "next", "id").sortWithinPartitions("near", "next", "id")


def build(rows: DataFrame, queries: Queries, n_docs: int, all_terms: int) -> DataFrame:
    """One row per chunk of consecutive documents: ids, forward lists, blocks and their maxima."""
    kind, together = rows.schema["id"].dataType.simpleString(), queries.together

    def read(batches):
        for b in slices(batches, CHUNK):
            t, tf, n = (b.column(c).to_pylist() for c in ("terms", "tf", "n"))
            docs = [(np.array(x, np.int64), impacts(np.array(y, np.int64), z, n_docs, all_terms)) for x, y, z in zip(t, tf, n, strict=True)]
            columns = [pa.array([c], k) for c, k in zip(index_chunk(docs, together), INDEX.types, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([b.column("id").to_pylist()], pa.list_(b.column("id").type)), *columns], names=["ids", *INDEX.names])

    return settle(rows.select("id", "n", "terms", "tf").mapInArrow(read, f"ids array<{kind}>, {INDEX_SQL}"))


def top(index: DataFrame, queries: Queries, k: int, kind: str) -> DataFrame:
    """(query, id, score): every task's best of each query."""

    def read(batches) -> Iterator[pa.RecordBatch]:
        best, ids = [Best(k) for _ in queries.keys], None
        for b in batches:
            ids = b.schema.field("ids").type.value_type
            for i in range(b.num_rows):
                chunk = {n: b.column(n)[i].values.to_numpy().astype(np.int64) for n in INDEX.names}
                search_chunk(b.column("ids")[i].as_py(), chunk, queries, best)
        if ids is not None:
            rows = [(q, r[2], -r[0]) for q, x in enumerate(best) for r in x.rows]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), ids, pa.int64()), strict=True)], names=["query", "id", "score"])

    return index.mapInArrow(read, f"query int, id {kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, leaders: int = 256, batch_bytes: int = 1 << 24, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: item, rank, document, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind, item_kind = docs.schema["id"].dataType.simpleString(), items.schema["item"].dataType
    asked = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    parts, out = max(1, -(-asked // batch_bytes)), None
    for part in range(parts):
        # at most about batch_bytes of query text: the items of a part by hash
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()]
        found = top_of_batch(docs, rows, k, leaders, kind)
        if found is None:
            continue
        keys = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(rows)], f"query int, item {item_kind.simpleString()}")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("id")))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k).join(keys, "query")
        best = best.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], f"{item_col} {item_kind.simpleString()}, rank int, {id_col} {kind}, score bigint")


def top_of_batch(docs: DataFrame, rows: list[tuple], k: int, leaders: int, kind: str) -> DataFrame | None:
    vocabulary = sorted({t for _, text in rows for t in terms(text)})
    if not vocabulary:
        return None
    found = occurrences(docs, vocabulary)
    n_docs, all_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {vocabulary[t]: n for t, n in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    if not df:
        return None
    queries = Queries(rows, df, n_docs)
    number = {t: i for i, t in enumerate(queries.names)}
    renumber = np.array([number.get(t, -1) for t in vocabulary], np.int64)
    n_weights = np.array([weight(n_docs, df[t]) for t in queries.names], np.float64)
    index = build(geometric(found, renumber, leaders, n_weights), queries, n_docs, all_terms)
    return top(index, queries, k, kind)
