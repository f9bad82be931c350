"""Bounded memories against a step-by-step simulation: what is held after every flush, and the edges in the end."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramspark.config import MemoryConfig
from engramspark.operators import graph, ingest, lifetimes
from engramspark.plans import index

HOUR = 3_600_000


class Simulation:
    """One store, one passage at a time."""

    def __init__(self, vectors, capacity, k, threshold):
        self.vectors, self.capacity, self.k, self.threshold = vectors, capacity, k, threshold
        self.passages, self.entities, self.facts, self.graph = {}, {}, {}, {}
        self.accesses = {}

    def link(self, a, b, w, add):
        for x, y in ((a, b), (b, a)):
            row = self.graph.setdefault(x, {})
            row[y] = row.get(y, 0.0) + w if add else w

    def index(self, seq, salience, now, triples):
        self.passages[seq] = (salience, now, triples)
        new = False
        for s, p, o in triples:
            for e in (s, o):
                new |= e not in self.entities
                self.entities.setdefault(e, set())
            self.facts.setdefault(f"{s} {p} {o}", seq)
            self.link(s, o, 1.0, add=True)
            for e in (s, o):
                self.entities[e].add(seq)
        if new:
            for a in self.entities:
                near = [(b, self.like(a, b)) for b in self.entities if b != a]
                near = sorted([x for x in near if x[1] >= self.threshold], key=lambda x: -x[1])[: self.k]
                if len(re.sub("[^a-z0-9]", "", a)) > 2:
                    for b, score in near:
                        self.link(a, b, score, add=False)

    def like(self, a, b):
        x, y = np.array(self.vectors[a], float), np.array(self.vectors[b], float)
        return round(float(x @ y / math.sqrt((x @ x) * (y @ y))), 9)

    def forget(self, now):
        def score(seq):
            salience, stored, _ = self.passages[seq]
            seen = [t for t in self.accesses.get(seq, ()) if t <= now]
            recency = 1 / (1 + (now - max(seen)) / HOUR) if seen else 0.0
            return (1 - salience) * math.log(1 + (now - stored) / HOUR) - recency

        for seq in sorted(self.passages, key=score, reverse=True)[: max(0, len(self.passages) - self.capacity)]:
            _, _, triples = self.passages.pop(seq)
            for s, p, o in triples:
                for e in (s, o):
                    if e in self.entities:
                        self.entities[e].discard(seq)
                        if not self.entities[e]:
                            del self.entities[e]
                            for row in self.graph.values():
                                row.pop(e, None)
                            self.graph.pop(e, None)
                fact = f"{s} {p} {o}"
                if not any(t == (s, p, o) for _, _, ts in self.passages.values() for t in ts):
                    self.facts.pop(fact, None)


@pytest.fixture(scope="module", params=[(4, 5, 2), (3, 6, 1), (12, 1, 3)])
def case(request, spark):
    """(capacity, passages a flush, k) over two stores; an access log; the tables and the simulations' states."""
    capacity, batch, k = request.param
    r = random.Random(capacity)
    names = [f"entity {c}" for c in "abcdefghij"] + ["ab"]
    vectors = {n: [r.randrange(-1, 3) for _ in range(3)] for n in names}
    vectors = {n: v if any(v) else [1, 0, 0] for n, v in vectors.items()}
    config = MemoryConfig(max_passages=capacity, synonymy_top_k=k, synonymy_threshold=0.49)
    passages, triples, log, after, sims = [], [], [], {}, {}
    for store in ("x", "y"):
        sim, seq = Simulation(vectors, capacity, k, 0.49), 0
        for flush in range(14):
            now, rows = (flush + 1) * 10 * HOUR, []
            for _ in range(r.randrange(1, batch + 1)):
                ts = [(r.choice(names), r.choice(["likes", "has"]), r.choice(names)) for _ in range(r.randrange(0, 4))]
                salience = r.choice([0.1, 0.3, 0.5, 0.9, r.random()])
                sim.index(seq, salience, now, ts)
                passages.append((store, flush, now, seq, salience, now))
                triples += [(store, seq, i, *t) for i, t in enumerate(ts)]
                seq += 1
            sim.forget(now)
            after[store, flush] = (set(sim.passages), set(sim.entities), dict(sim.facts))
            for p in r.sample(sorted(sim.passages), min(2, len(sim.passages))):
                at = now + r.randrange(1, 10) * HOUR
                sim.accesses.setdefault(p, []).append(at)
                log.append((store, p, at))
            log.append((store, 999, now + 1))
        sims[store] = sim
    p = spark.createDataFrame(passages, "store_id string, flush int, flush_ms bigint, passage_seq bigint, salience double, timestamp_ms bigint")
    t = spark.createDataFrame(triples, "store_id string, passage_seq bigint, ord int, subject string, predicate string, object string")
    a = spark.createDataFrame(log, "store_id string, passage_seq bigint, at_ms bigint")
    e = spark.createDataFrame([(s, n, [float(x) for x in v]) for s in "xy" for n, v in vectors.items()], "store_id string, entity string, vec array<double>")
    lives = lifetimes.passage_lifetimes(p, a, config).cache()
    return config, p, t, e, lives, after, sims, a


def test_every_flush(case):
    config, p, t, _, lives, after, *_ = case
    entities, facts = lifetimes.entity_lifetimes(t, lives).cache(), lifetimes.fact_lifetimes(t, lives).cache()
    assert lives.count() == p.count()
    counted = {(r.store_id, r.flush): r for r in lifetimes.sizes(p, passages=lives, entities=entities, facts=facts).collect()}
    tables = {n: df.collect() for n, df in (("p", lives), ("e", entities), ("f", facts))}
    for (store, flush), (held_passages, held_entities, held_facts) in after.items():
        p, e, f = ([r for r in tables[n] if r.store_id == store and r.born <= flush and (r.died is None or r.died > flush)] for n in "pef")
        assert {r.passage_seq for r in p} == held_passages
        assert {r.entity for r in e} == held_entities
        assert {r.fact: r.owner_seq for r in f} == held_facts
        assert tuple(counted[store, flush])[2:] == (len(held_passages), len(held_entities), len(held_facts))
    for flush in (6, None):
        got = {(r.store_id, r.entity) for r in lifetimes.held(entities, flush).collect()}
        assert got == {(s, e) for (s, n), (_, es, _) in after.items() if n == (13 if flush is None else flush) for e in es}


def test_edges_in_the_end(case):
    config, _, t, e, lives, _, sims, _ = case
    entities = lifetimes.entity_lifetimes(t, lives)
    got = {(r.store_id, r.src, r.dst): round(r.w, 6) for r in lifetimes.ledger_with_removals(t, e, entities, lives, config).collect()}
    want = {(s, f"entity:{a}", f"entity:{b}"): round(w, 6) for s, sim in sims.items() for a, row in sim.graph.items() for b, w in row.items()}
    assert got == want


def test_memory_after_the_last_flush(case):
    config, p, t, e, _, after, sims, log = case
    passages = p.select("store_id", "passage_seq", F.lit("").alias("passage_id"), F.lit("").alias("text"), F.array().cast("array<string>").alias("types"), "salience", "timestamp_ms")
    entities = ingest.build_entities(t).join(e, ["store_id", "entity"])
    none = t.select("store_id", F.col("subject").alias("src"), F.col("object").alias("dst"), F.lit(0.0).alias("w")).limit(0)
    full = index.Memory(passages, t, ingest.build_facts(t).withColumn("vec", F.lit(None)), entities, ingest.build_mentions(t), none, graph.graph_nodes(entities, passages))
    m = index.bounded_memory(full, p.select("store_id", "passage_seq", "flush", "flush_ms"), log, config)
    for store, sim in sims.items():
        mine = lambda df: df.where(f"store_id = '{store}'").collect()  # noqa: E731, B023
        assert {r.passage_seq for r in mine(m.passages)} == set(sim.passages)
        assert {r.entity for r in mine(m.entities)} == set(sim.entities)
        assert {r.fact: r.owner_seq for r in mine(m.facts)} == sim.facts
        assert {(r.entity, r.passage_seq) for r in mine(m.mentions)} == {(x, s) for x, seqs in sim.entities.items() for s in seqs}
        want = {(f"entity:{a}", f"entity:{b}"): round(w, 6) for a, row in sim.graph.items() for b, w in row.items()}
        want |= {k: 1.0 for x, seqs in sim.entities.items() for s in seqs for k in ((f"entity:{x}", f"passage:{s}"), (f"passage:{s}", f"entity:{x}"))}
        assert {(r.src, r.dst): round(r.w, 6) for r in mine(m.edges)} == want


def test_long_flush_and_no_rows(spark):
    """A flush far beyond capacity is cut as it streams; empty tables give empty results."""
    schema = "store_id string, flush int, flush_ms bigint, passage_seq bigint, salience double, timestamp_ms bigint"
    rows = spark.range(120_000).selectExpr("'x' AS store_id", "0 AS flush", "3600000L AS flush_ms", "id AS passage_seq", "(id * 7919 % 120000) / 120000D AS salience", "0L AS timestamp_ms")
    got = lifetimes.passage_lifetimes(rows, config=MemoryConfig(max_passages=50))
    kept = {r.passage_seq for r in got.where("died IS NULL").collect()}
    assert kept == {r.passage_seq for r in rows.orderBy(rows.salience.desc()).limit(50).collect()}
    assert got.where("died = 0").count() == 119_950
    assert lifetimes.passage_lifetimes(spark.createDataFrame([], schema)).count() == 0
