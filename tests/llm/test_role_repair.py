"""Structure repair against an exhaustive search over edits and a plain version of the whole query."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from engramspark.llm.role_repair import damaged_and_repaired

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def plain_faults(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(WHITE)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return faults


def plain_parse(rows, faults):
    """Least (cost, audit, repaired rows) by dynamic programming over the regular language, in whole strings."""
    moves = {"0": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "B"}, "B": {"u": "U"}}
    live = {"0": (0, "", ())}

    def inserts(live):
        for _ in range(4):
            for state, (cost, audit, kept) in list(live.items()):
                for x, name in (("u", "user"), ("a", "assistant")):
                    if to := moves[state].get(x):
                        new = (cost + 5, audit + "I", (*kept, (name, "")))
                        live[to] = min(live.get(to, new), new)

    inserts(live)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, kept) in live.items():
            ways = [(state, (cost + 2, audit + "D", kept))]
            if fault not in ("blank", "duplicate"):
                stay = 5 if fault == "truncated" else 0
                if to := moves[state].get(role[:1]):
                    ways.append((to, (cost + stay, audit + "K", (*kept, (role, text)))))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if to := moves[state].get(x):
                        ways.append((to, (cost + 1 + stay, audit + "R", (*kept, (name, text)))))
            for to, new in ways:
                after[to] = min(after.get(to, new), new)
        live = after
        inserts(live)
    return min(v for k, v in live.items() if k in "0B")


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = plain_damage([r for r in rows if r[0] == conv])
        faults, turns = plain_faults(mine), {t for t, _, _ in mine if t is not None}
        cost, audit, kept = plain_parse(mine, faults)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def exhaustive(rows, faults):
    """Every edit script with at most two inserts in a place."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    for choice in itertools.product(*([["K", "Ru", "Ra", "D"]] * len(rows))):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            cost = 5 * sum(map(len, ins))
            audit, roles = "I" * len(ins[0]), ins[0]
            ok = True
            for (row, fault, how, after) in zip(rows, faults, choice, ins[1:], strict=True):
                if how == "D":
                    cost += 2
                else:
                    ok &= fault not in ("blank", "duplicate")
                    cost += (how != "K") + (5 if fault == "truncated" else 0)
                    roles += row[1][:1] if how == "K" else how[1]
                audit += how[0] + "I" * len(after)
                roles += after
            if ok and re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (cost, audit), (cost, audit))
    return best


def check(spark, rows, cut=1024, schema=SCHEMA):
    got = damaged_and_repaired(spark.createDataFrame(rows, schema), cut).collect()
    want = plain([r[:4] for r in rows])
    assert len(got) == len(want)
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_plain_version_is_the_cheapest_script():
    r = random.Random(5)
    for _ in range(40):
        rows = [(i, r.choice(["system", "user", "assistant", "tool"]), r.choice(["a.", "b", "c!", ""])) for i in range(r.randrange(4))]
        faults = plain_faults(rows)
        assert plain_parse(rows, faults)[:2] == exhaustive(rows, faults)


@pytest.mark.parametrize("cut", [1024, 3])
def test_random_conversations(spark, cut):
    r = random.Random(cut)
    rows = [
        (conv, r.choice([None, *range(8)]) if conv % 3 else turn, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), r.choice(["Yes.", "no", "é!", " ", None, f"w{turn}?"]))
        for conv in range(60) for turn in range(r.randrange(1, 30))
    ]
    check(spark, rows, cut)


@pytest.mark.parametrize("cut", [1024, 100])
def test_one_long_conversation(spark, cut):
    r = random.Random(9)
    rows = [(7, i, r.choice(["user", "assistant", "x"]), r.choice([f"w{i}.", f"w{i}", "same."])) for i in range(6000)] + [(8, 0, "user", "Hi.")]
    check(spark, rows, cut)


def test_equal_costs_everywhere(spark):
    check(spark, [(1, i, "x", f"w{i}.") for i in range(3001)], 64)


def test_odd_rows(spark):
    check(spark, [])
    long = "é word. " * 60_000
    check(spark, [(None, None, None, None), (None, 1, "user", "a."), (1, 1, "user", long), (1, 2, "assistant", long), (2, 5, "user", "x."), (2, 5, "user", "x.")])
    extra = [(i, 1, "user", "a.", 3, "x") for i in range(40)]
    check(spark, extra, schema=SCHEMA + ", later int, digest string")
