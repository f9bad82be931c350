"""Conversation structure repair by generalised LR parsing with weighted edits.

The role grammar ``(s?(ua)+)?`` has LR tables (`SHIFT`, `REDUCE`, `GOTO`). A parse keeps a graph-structured stack: every live stack
top has one link to what lies beneath, and the least (cost, audit) of all ways to it. Per row each top is followed by keep,
rerole and delete, after each row by inserts; equal tops are merged by the minimum. Two audits of one cost never have one as
the start of the other (they differ in inserts alone, which cost), so the least start always gives the least whole.

Conversations of any length are split: rows are dealt by range of (conversation, turn), a slice is read as a stream, and a
conversation within a slice is done there. One that crosses slices, or has more than ``cut`` rows, becomes fragments. A fragment is
parsed from every possible top (a table of entry, exit, cost, audit); tables are then chained in order, which settles
each fragment's entry and audit, and the fragments are repaired apart from each other. Only the final digest of such a
conversation is a chain by nature; it streams, so no task holds more than a fragment.

Defined results: null role or text is one space, a null turn comes first and has no part in ``gaps``, null conversation ids form one
conversation. Rows of one turn are ordered by (role, text) after damage; identical rows follow each other and count as duplicates. Empty
tables give empty results. Long texts are held one fragment (``cut`` rows) at a time. An empty role has no initial and fits
nowhere in the grammar. Further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramspark.llm.shared import settle

ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: From any top the remaining input can be parsed for at most this much more than from any other: two inserts and a deleted system row.
SLACK = 2 * INSERT + DELETE
WHITE = " \t\n\x0b\x0c\r"

# Grammar: C -> . | B    H -> . | s    B -> H u a | B u a
# States: 0 start, 1 s, 2 H, 3 B, 4 H u, 5 H u a, 6 B u, 7 B u a
SHIFT = {(0, "s"): 1, (2, "u"): 4, (4, "a"): 5, (3, "u"): 6, (6, "a"): 7}
#: state -> (symbols popped, nonterminal): reductions that need no lookahead, and that of the empty H before a u.
REDUCE = {1: (1, "H"), 5: (3, "B"), 7: (3, "B")}
REDUCE_ON = {(0, "u"): (0, "H")}
GOTO = {(0, "H"): 2, (0, "B"): 3}
ACCEPT = (0, 3)
#: All stacks that stand between two rows, reductions done.
STACKS = ((0,), (0, 2), (0, 2, 4), (0, 3), (0, 3, 6))


def reduced(stack: tuple[int, ...], rule: tuple[int, str]) -> tuple[int, ...]:
    popped, symbol = rule
    stack = stack[: len(stack) - popped]
    return (*stack, GOTO[stack[-1], symbol])


@functools.cache
def advance(stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
    """The stack after shifting ``symbol`` and every reduction that follows; None if the grammar has no such move."""
    if rule := REDUCE_ON.get((stack[-1], symbol)):
        stack = reduced(stack, rule)
    if (state := SHIFT.get((stack[-1], symbol))) is None:
        return None
    stack = (*stack, state)
    while rule := REDUCE.get(stack[-1]):
        stack = reduced(stack, rule)
    return stack


class Parse:
    """Live stack tops from one entry: stack -> (cost, rank, tail, chain).

    An audit is a chain of frozen pieces and a tail. Frozen parts are equally long, so their order among the live tops (``rank``)
    never changes, and appending an edit does not copy the whole audit.
    """

    FREEZE = 512

    def __init__(self, entry: tuple[int, ...] = (0,)):
        self.live = {entry: (0, 0, "", None)}
        self.insert()

    @staticmethod
    def offer(to: dict, stack: tuple[int, ...], cost: int, rank: int, tail: str, chain) -> bool:
        old = to.get(stack)
        if old is None or (cost, rank, tail) < old[:3]:
            to[stack] = (cost, rank, tail, chain)
            return True
        return False

    def insert(self) -> None:
        """Close the live tops under inserts, and drop those no cheapest repair can pass."""
        live, changed = self.live, True
        while changed:
            changed = False
            for stack, (cost, rank, tail, chain) in list(live.items()):
                for symbol in ROLES:
                    if after := advance(stack, symbol):
                        changed |= self.offer(live, after, cost + INSERT, rank, tail + "I", chain)
        least = min(v[0] for v in live.values())
        self.live = {k: v for k, v in live.items() if v[0] <= least + SLACK}

    def row(self, initial: str, must_delete: bool, truncated: bool) -> None:
        after: dict = {}
        stay = TRUNCATED if truncated else 0
        for stack, (cost, rank, tail, chain) in self.live.items():
            self.offer(after, stack, cost + DELETE, rank, tail + "D", chain)
            if must_delete:
                continue
            if initial and (to := advance(stack, initial)):
                self.offer(after, to, cost + stay, rank, tail + "K", chain)
            for symbol in ROLES:
                if to := advance(stack, symbol):
                    self.offer(after, to, cost + REROLE + stay, rank, tail + "R", chain)
        self.live = after
        self.insert()
        if len(next(iter(self.live.values()))[2]) > self.FREEZE:
            self.freeze()

    def freeze(self) -> None:
        """Move what all tails have in length to the chains."""
        size = min(len(v[2]) for v in self.live.values())
        order = {key: i for i, key in enumerate(sorted({(v[1], v[2][:size]) for v in self.live.values()}))}
        self.live = {
            k: (cost, order[rank, tail[:size]], tail[size:], (chain, tail[:size])) for k, (cost, rank, tail, chain) in self.live.items()
        }

    @staticmethod
    def audit(of: tuple) -> str:
        parts, chain = [of[2]], of[3]
        while chain:
            parts.append(chain[1])
            chain = chain[0]
        return "".join(reversed(parts))

    def end(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest accepted parse."""
        best = min((v for k, v in self.live.items() if k[-1] in ACCEPT), key=lambda v: v[:3])
        return best[0], self.audit(best)


def repaired(entry: tuple[int, ...], audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(edit, role, text) of what a fragment's audit keeps, reroles and inserts."""
    out, stack, left = [], entry, iter(rows)
    for edit in audit:
        role, text = next(left) if edit != "I" else ("", "")
        if edit == "D":
            continue
        symbol = role[:1] if edit == "K" else next(x for x in ROLES if advance(stack, x))
        stack = advance(stack, symbol)
        out.append((edit, role if edit == "K" else ROLES[symbol], text))
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` after the contract's damage; a dropped row stays as ``dropped`` so that its conversation is known."""
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), times.alias("copy")).drop("copy")


ROWS = "array<struct<edit:string,role:string,text:string>>"
TABLE = "array<struct<entry:int,exit:int,cost:bigint,audit:string>>"
FACTS = "rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first_turn bigint, last_turn bigint, first_initial string, last_initial string"
ROW_TYPE = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
TABLE_TYPE = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
FACT_FIELDS = [(n, pa.string() if n.endswith("initial") else pa.int64()) for n in (f.split()[0] for f in FACTS.split(", "))]
LEGAL = {"su", "ua", "au"}


class Fragment:
    """Consecutive rows of one conversation: counts, texts and parses from every entry it may have."""

    def __init__(self, conv_id, begins: bool):
        self.conv_id, self.begins = conv_id, begins
        self.parses = {e: Parse(e) for e in (STACKS[:1] if begins else STACKS)}
        self.texts: list[tuple[str, str]] = []
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        self.rows += 1
        self.texts.append((role, text))
        initial, core = role[:1], text.rstrip(WHITE)
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.illegal += self.last_initial + initial not in LEGAL
        self.last_initial = initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        blank = not core
        truncated = not blank and not repeated and core[-1] not in ".!?"
        self.blank += blank
        self.duplicate += not blank and repeated
        self.truncated += truncated
        for p in self.parses.values():
            p.row(initial, blank or repeated, truncated)

    def facts(self) -> tuple:
        return tuple(getattr(self, name) for name, _ in FACT_FIELDS)

    def table(self) -> list[dict]:
        return [
            {"entry": STACKS.index(e), "exit": STACKS.index(x), "cost": v[0], "audit": p.audit(v)} for e, p in self.parses.items() for x, v in p.live.items()
        ]


def fragments(rows: DataFrame, cut: int) -> DataFrame:
    """One row per conversation that lies within a slice (``whole``), else one per fragment in the order (slice, no)."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def read(batches) -> Iterator[pa.RecordBatch]:
        slice_, no, out, ids = TaskContext.get().partitionId(), 0, [], None
        current, last, seen_other = None, None, False

        def close(whole: bool) -> None:
            nonlocal no
            f = current
            cost = audit = None
            if whole:
                (entry, parse), = f.parses.items()
                cost, audit = parse.end()
                lines = [dict(zip(("edit", "role", "text"), x, strict=True)) for x in repaired(entry, audit, f.texts)]
            else:
                lines = [{"edit": None, "role": r, "text": t} for r, t in f.texts]
            out.append((f.conv_id, slice_, no, whole, *f.facts(), cost, audit, None if whole else f.table(), lines))
            no += 1

        def batch() -> pa.RecordBatch:
            names = ["conv_id", "slice", "no", "whole", *(n for n, _ in FACT_FIELDS), "cost", "audit", "table", "lines"]
            types = [ids, pa.int32(), pa.int32(), pa.bool_(), *(t for _, t in FACT_FIELDS), pa.int64(), pa.string(), TABLE_TYPE, ROW_TYPE]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
            return made

        for b in batches:
            ids = b.schema.field("conv_id").type
            for conv_id, turn, role, text, dropped, later in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "later")), strict=True):
                if current is not None and conv_id != current.conv_id:
                    close(whole=seen_other and current.begins)
                    current, last, seen_other = None, None, True
                elif current is not None and current.rows >= cut:
                    close(whole=False)
                    current = Fragment(conv_id, begins=False)
                if current is None:
                    current = Fragment(conv_id, begins=seen_other)
                if not dropped:
                    current.add(turn, role, text, later or last == (turn, role, text))
                    last = (turn, role, text)
                if len(out) >= 256:
                    yield batch()
        if current is not None:
            close(whole=False)
        if out:
            yield batch()

    cut_rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {kind}, slice int, no int, whole boolean, {FACTS}, cost bigint, audit string, table {TABLE}, lines {ROWS}"
    return settle(cut_rows.mapInArrow(read, schema))


def mark_repeated(rows: DataFrame) -> DataFrame:
    """``later``: the same role and text stand at an earlier turn of the conversation. Identical rows of one turn are left to the reader.

    First turns are aggregated before the shuffle, and only texts that occur twice are joined back.
    """
    keyed = rows.withColumn("digest", F.md5("text"))
    said = keyed.where("not dropped").groupBy("conv_id", "role", "digest").agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("first"))
    said = said.where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    on = keyed["conv_id"].eqNullSafe(said["c"]) & (keyed["role"] == said["r"]) & (keyed["digest"] == said["d"])
    return keyed.join(said, on, "left").select(*rows.columns, (F.col("first").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("first"))).alias("later"))


def chained(live: dict, table: list[dict]) -> dict:
    """The live tops (stack -> cost, rank, tail, path) after a fragment's table; a path lists (entry, audit) of every fragment."""
    after: dict = {}
    for line in table:
        if old := live.get(STACKS[line["entry"]]):
            Parse.offer(after, STACKS[line["exit"]], old[0] + line["cost"], old[1], old[2] + line["audit"], (old[3], line["entry"], line["audit"]))
    least = min(v[0] for v in after.values())
    after = {k: v for k, v in after.items() if v[0] <= least + SLACK}
    size = min(len(v[2]) for v in after.values())
    order = {key: i for i, key in enumerate(sorted({(v[1], v[2][:size]) for v in after.values()}))}
    return {k: (cost, order[rank, tail[:size]], tail[size:], path) for k, (cost, rank, tail, path) in after.items()}


def total(facts: dict | None, more: dict) -> dict:
    """Counts of two consecutive stretches of one conversation."""
    if facts is None or not facts["rows"]:
        return more
    if not more["rows"]:
        return facts
    out = {n: facts[n] + more[n] for n in ("rows", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += facts["last_initial"] + more["first_initial"] not in LEGAL
    out["turns"] -= facts["last_turn"] is not None and facts["last_turn"] == more["first_turn"]
    for n in ("first_turn", "first_initial"):
        out[n] = more[n] if facts[n] is None else facts[n]
    for n in ("last_turn", "last_initial"):
        out[n] = facts[n] if more[n] is None else more[n]
    return out


def chain(open_: DataFrame) -> DataFrame:
    """Entry and audit of every fragment; the first one of a conversation also has the conversation's totals.

    Tables without texts stream in order; what is kept of a conversation is as long as its audit.
    """
    kind = open_.schema["conv_id"].dataType.simpleString()
    names = [n for n, _ in FACT_FIELDS]
    columns = ["conv_id", "slice", "no", "entry", "piece", *names, "cost", "audit"]

    def read(batches) -> Iterator[pa.RecordBatch]:
        ids, current, live, seen, facts = None, None, None, [], None

        def done() -> pa.RecordBatch:
            best = min((v for k, v in live.items() if k[-1] in ACCEPT), key=lambda v: v[:3])
            pieces, path = [], best[3]
            while path:
                pieces.append(path[1:])
                path = path[0]
            pieces.reverse()
            totals = (*(facts[n] for n in names), best[0], "".join(p for _, p in pieces))
            rows = [(current, *at, *piece, *(totals if not i else [None] * len(totals))) for i, (at, piece) in enumerate(zip(seen, pieces, strict=True))]
            types = [ids, pa.int32(), pa.int32(), pa.int32(), pa.string(), *(t for _, t in FACT_FIELDS), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=columns)

        for b in batches:
            ids = b.schema.field("conv_id").type
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in b.schema.names}
                if live is not None and row["conv_id"] != current:
                    yield done()
                    live = None
                if live is None:
                    current, live, seen, facts = row["conv_id"], {(0,): (0, 0, "", None)}, [], None
                live = chained(live, row["table"])
                seen.append((row["slice"], row["no"]))
                facts = total(facts, row)
        if live is not None:
            yield done()

    tables = open_.select("conv_id", "slice", "no", *names, "table").repartition("conv_id").sortWithinPartitions("conv_id", "slice", "no")
    return settle(tables.mapInArrow(read, f"conv_id {kind}, slice int, no int, entry int, piece string, {FACTS}, cost bigint, audit string"))


def repair_fragment(entry: int, piece: str, lines: list) -> list:
    return repaired(STACKS[entry], piece, [(x["role"], x["text"]) for x in lines])


def digest_in_order(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the joined pieces (conv_id, slice, no, body) of every conversation, read as a stream; a null body has no rows."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def read(batches) -> Iterator[pa.RecordBatch]:
        ids, current, state, empty = None, None, None, True

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], ids), pa.array([state.hexdigest()])], names=["conv_id", "sha"])

        for b in batches:
            ids = b.schema.field("conv_id").type
            for i in range(b.num_rows):
                conv_id, body = b.column("conv_id")[i].as_py(), b.column("body")[i].as_py()
                if state is not None and conv_id != current:
                    yield done()
                    state = None
                if state is None:
                    current, state, empty = conv_id, hashlib.sha256(), True
                if body is not None:
                    state.update((body if empty else "\n" + body).encode())
                    empty = False
        if state is not None:
            yield done()

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "slice", "no").select("conv_id", "body").mapInArrow(read, f"conv_id {kind}, sha string")


def repair(conversations: DataFrame, cut: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(totals per conversation, repaired rows).

    Repaired rows stand in arrays (``lines``: edit, role, text) ordered by (slice, no); a ``whole`` conversation has one array.
    ``conversations`` has conv_id, turn, role, text, dropped.
    """
    found = fragments(mark_repeated(conversations), cut)
    facts = [n for n, _ in FACT_FIELDS]
    whole, open_ = found.where("whole"), found.where("not whole")
    pieces = chain(open_)
    lines = open_.select("slice", "no", "lines").join(pieces.select("conv_id", "slice", "no", "entry", "piece"), ["slice", "no"])
    lines = lines.select("conv_id", "slice", "no", F.lit(False).alias("whole"), F.udf(repair_fragment, ROWS)("entry", "piece", "lines").alias("lines"))
    totals = whole.select("conv_id", *facts, "cost", "audit").unionByName(pieces.where("cost is not null").select("conv_id", *facts, "cost", "audit"))
    return totals, whole.select("conv_id", "slice", "no", "whole", "lines").unionByName(lines)


def damaged_and_repaired(conversations: DataFrame, cut: int = 1024) -> DataFrame:
    """The contract's row per conversation: counts, cost, audit and digest of the repaired text."""
    totals, lines = repair(damage(conversations), cut)
    body = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    body = lines.withColumn("body", F.when(F.size("lines") > 0, body))
    whole = body.where("whole").select("conv_id", F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256).alias("sha"))
    sha = whole.unionByName(digest_in_order(body.where("not whole").select("conv_id", "slice", "no", "body"))).withColumnRenamed("conv_id", "c")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return totals.join(sha, totals["conv_id"].eqNullSafe(sha["c"])).select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256")
    )
