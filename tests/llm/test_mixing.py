"""Raking against a plain version, margins and budget."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from engramspark.llm.mixing import MARGINS, MixSettings, mix, rake, sampled

S = MixSettings()


def topic(t):
    low = t.lower()
    marks = (("table", " | " in t), ("contact", "@" in t), ("code", "=" in t), ("legal", "license" in low or "rights reserved" in low), ("long", len(t) >= 4000))
    return next((name for name, there in marks if there), "prose")


def brute(rows):
    """rows: (id, text, source, lang)"""
    known = [(i, s or "", g or "", topic(t or ""), max(1, math.ceil(len((t or "").encode()) / 4))) for i, t, s, g in rows]
    w = Counter()
    for _, s, g, t, n in known:
        w[s, g, t] += n
    total = sum(w.values())
    fit, share = {k: v / total for k, v in w.items()}, []
    for m, p in enumerate(S.powers):
        sums = Counter()
        for k, v in w.items():
            sums[k[m]] += v
        powers = {k: v**p for k, v in sums.items()}
        share.append({k: v / sum(powers.values()) for k, v in powers.items()})
    for _ in range(S.rounds):
        for m in range(3):
            now = defaultdict(float)
            for k, v in fit.items():
                now[k[m]] += v
            fit = {k: v * share[m][k[m]] / now[k[m]] for k, v in fit.items()}
    scale = S.budget * total
    for _ in range(S.fills):
        full = sum(w[k] for k in w if fit[k] * scale >= w[k])
        rest = sum(fit[k] * scale for k in w if fit[k] * scale < w[k])
        if rest <= 0:
            break
        scale *= (S.budget * total - full) / rest
    rate = {k: round(min(1.0, fit[k] * scale / w[k]), 9) for k in w}
    out = []
    for i, s, g, t, n in known:
        u = int(hashlib.md5((S.salt + ("" if i is None else str(i))).encode()).hexdigest()[:8], 16) / 2**32
        out.append((i, s, g, t, n, rate[s, g, t], u < rate[s, g, t]))
    return out


def check(docs):
    got = sorted(sampled(docs).drop("row").collect(), key=str)
    want = sorted(brute([tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()]), key=str)
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=lambda r: (str(r[0]), r[4], str(r))), sorted(want, key=lambda r: (str(r[0]), r[4], str(r))), strict=True):
        assert a[:5] == b[:5] and a[6] == b[6]
        assert a[5] == pytest.approx(b[5], abs=2e-9)
    return got


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check(docs)
    expected = sum(r.tokens * r.rate for r in got)
    assert expected == pytest.approx(S.budget * sum(r.tokens for r in got), rel=0.02)
    kept = mix(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_margins_meet_given_targets(spark):
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", (i + 2) * (j + 1) * (3 * k + 1) + i * j * k) for i in range(4) for j in range(3) for k in range(2)], "source string, lang string, topic string, w long")
    shares = {"source": (0.4, 0.3, 0.2, 0.1), "lang": (0.2, 0.3, 0.5), "topic": (0.5, 0.5)}
    targets = {m: spark.createDataFrame([(f"{m[0]}{i}", s) for i, s in enumerate(v)], "value string, share double") for m, v in shares.items()}
    fitted = rake(cells, targets, rounds=25).collect()
    for m in MARGINS:
        for i, s in enumerate(shares[m]):
            assert sum(r.fit for r in fitted if r[m] == f"{m[0]}{i}") == pytest.approx(s, abs=1e-6)


def test_edges(spark):
    data = [(i, "text " * (i % 7 + 1), "big" if i % 3 else None, None if i % 5 == 0 else "en", 1) for i in range(60)]
    data += [(None, None, "x", "en", 1), (7, "", "x", None, 1), (7, "a @ b", "x", "fr", 1), (7, "a @ b", "x", "fr", 1), (8, "w = " * 50_000, "big", "en", 1)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string, lang string, rate int")
    check(docs)
    assert mix(docs).columns == docs.columns
    assert mix(docs.limit(0)).count() == 0
