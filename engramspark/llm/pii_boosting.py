"""Personal data by candidate generation and gradient boosting.

Strict patterns give the base spans, which always stay. Generators with high recall then propose overlapping candidates: every
window of digit groups that may be a card or telephone number, four small groups with dotted or bracketed separators, and words around
a written or bracketed "at". Boosted trees (symmetric trees, logistic loss) score a candidate by its format and its context;
per kind the threshold is the least at which the precision on spans kept out of the fit reaches ``precision``. Of
overlapping candidates above their thresholds the best stays, unless it overlaps a base span.

Labels come from the corpus itself: base spans and rewritten forms of them in their own surroundings are positive, all other candidates
that touch those and natural candidates elsewhere negative. All of them are learned from, each distinct window once: tasks make
the examples and count equal ones, every level of a tree is chosen by sums of gradients per feature value that tasks add up, and
precision is summed over all scores kept out. The driver sees sums of fixed size only. Gradients are added as
integers, so the trees do not depend on how rows are dealt. Without base spans of a kind nothing is added to it.

Defined results: a null text is an empty one, with zero counts and no spans; repeated rows give repeated results; an empty table gives
an empty one; further columns are ignored. All patterns run in time linear in the text, whose length has no bound; memory is a small
multiple of one text and its spans. Equal scores go to the earlier, then the longer candidate.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramspark.llm.shared import settle, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]
CONTEXT = 48
#: Base spans of a kind from which on each is rewritten once only.
FORMS = 400
#: Feature values from BINS - 1 on are alike.
BINS = 64
#: Gradients are added in steps of 1 / SCALE.
SCALE = 1 << 26
#: Windows whose examples a task makes, and windows whose distinct examples are one file of the training table.
WINDOWS_PER_TASK, WINDOWS_PER_FILE = 1000, 4000
#: From more tasks than this on their sums are added up by Spark before the driver sees them.
TASKS_SUMMED = 32

LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

#: A written at sign, and what may follow it.
AT = re.compile(r" ?(?:[\[({<] ?(?:at|AT|@) ?[\])}>]|@) ?| (?:at|AT) ")
WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]++)+")
GROUP = re.compile("[0-9]++")
#: Digit groups of one number, as they are written.
MOST_GROUPS = 6
#: Between the digit groups of one number.
BETWEEN = re.compile(r"[ ().\[\]-]{0,4}\Z")
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def small(part: str) -> bool:
    """At most 255, with any number of leading zeros."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def local_start(text: str, at: int, floor: int) -> int:
    """Start of the run of address characters that ends before ``at``, read backwards in steps."""
    start, step = at, 64
    while start > floor:
        low = max(floor, start - step)
        size = len(text[low:start].rstrip(LOCAL))
        start = low + size
        if size:
            break
        step *= 2
    return start


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost spans of the strict patterns, per kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    at, floor = text.find("@"), 0
    while at >= 0:
        if (m := DOMAIN.match(text, at + 1)) and (start := local_start(text, at, floor)) < at:
            out["email"].append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    if not DIGIT.search(text):
        return out
    for m in DOTTED.finditer(text):
        groups = list(GROUP.finditer(text, m.start(), m.end()))
        for four in (groups[i : i + 4] for i in range(0, len(groups) - 3, 4)):
            if all(small(g.group()) for g in four):
                out["ip"].append((four[0].start(), four[-1].end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                out["phone"].append(m.span())
    return out


def number_windows(text: str) -> Iterator[tuple[str, Span]]:
    """Candidates of up to MOST_GROUPS consecutive digit groups."""
    groups: list[re.Match] = []

    def windows() -> Iterator[tuple[str, Span]]:
        for i, first in enumerate(groups):
            digits = 0
            for j in range(i, min(i + MOST_GROUPS, len(groups))):
                digits += groups[j].end() - groups[j].start()
                if digits > 19:
                    break
                start, end = first.start(), groups[j].end()
                between = [text[groups[k].end() : groups[k + 1].start()] for k in range(i, j)]
                if j - i == 3 and all(re.fullmatch(r" ?[\[(]? ?\. ?[\])]? ?", x) for x in between) and all(small(g.group()) and len(g.group()) < 4 for g in groups[i : j + 1]):
                    yield "ip", (start, end)
                if 13 <= digits and all(x in (" ", "-", ".") for x in between):
                    yield "card", (start, end)
                if 7 <= digits <= 15:
                    opened = text[start - 1 : start] == "("
                    if opened and text[start - 2 : start - 1] == "+":
                        yield "phone", (start - 2, end)
                    yield "phone", (start - (opened or text[start - 1 : start] == "+"), end)

    for m in GROUP.finditer(text):
        if groups and not BETWEEN.match(text[groups[-1].end() : min(m.start(), groups[-1].end() + 5)]):
            yield from windows()
            groups.clear()
        groups.append(m)
        if len(groups) >= 4000:  # a long table of numbers: go on with the last groups, windows seen twice are equal
            yield from windows()
            del groups[: 1 - MOST_GROUPS]
    yield from windows()


def candidates(text: str) -> list[tuple[str, int, int]]:
    """All proposals of all generators, overlapping ones included."""
    out = []
    for m in AT.finditer(text):
        if (d := WRITTEN_DOMAIN.match(text, m.end())) and (start := local_start(text, m.start(), 0)) < m.start():
            out.append(("email", start, d.end()))
    if DIGIT.search(text):
        out += [(k, *s) for k, s in number_windows(text)]
    return list(dict.fromkeys(out))


SIDE = {c: i for i, c in enumerate(" .,;:!?()[]\"'#*$%&|<>=/-+@")}


def side(c: str) -> int:
    return 60 if c == "" else 62 if c.isdigit() else 61 if c.isalpha() else SIDE.get(c, 40)


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Format and context of a candidate as small integers."""
    span = text[start:end]
    digits = "".join(c for c in span if c.isdigit())
    sizes = [m.end() - m.start() for m in GROUP.finditer(span)]
    left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    before, after = left.rstrip(" (")[-1:], right.lstrip(" )")[:1]
    tail = span.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower()
    seps = [c for c in span if not c.isalnum()]
    return [
        KINDS.index(kind), len(digits), len(span), len(sizes), sizes[0] if sizes else 0, sizes[-1] if sizes else 0, max(sizes, default=0), min(sizes, default=0),
        luhn(digits) if 12 < len(digits) < 20 else 2, int(digits[:1] or 10), int(sizes[-2:] == [3, 4]), int(sizes[-3:] == [3, 3, 4]), int(set(sizes) == {4}),
        span.count(" "), span.count("-"), span.count("."), 2 * span.count("(") + span.count(")"), int("(" in span), int(span[:1] == "+"), len(set(seps)),
        side(text[start - 1 : start] if start else ""), side(text[end : end + 1]), int(before.isdigit()), int(after.isdigit()),
        int(right[:1] in (".", "-") and right[1:2].isdigit()), int(left[-1:] in (".", "-") and left[-2:-1].isdigit()),
        int("@" in span), int(bool(re.search(r"(?i)[\[({<] ?(at|dot|\.) ?[\])}>]", span))), int(" at " in span.lower()), int(" dot " in span.lower()),
        int(tail in TOP_LEVEL), min(len(tail), 12), int(any(c.isdigit() for c in span[: span.find("@")])), sum(map(str.isdigit, left)), sum(map(str.isdigit, right)),
    ]


class Boosted:
    """Symmetric boosted trees: each has one (feature, bound) per level and a value per leaf.

    Examples are columns (features by rows) with the number of positive ones and of all ones that a row stands for.
    """

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.3, bins: int = BINS, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[list[tuple[int, int]], np.ndarray]] = []
        self.base = 0.0

    def columns(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.clip(x, 0, self.bins - 1).T)

    @staticmethod
    def leaves(columns: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
        leaf = np.zeros(columns.shape[1], np.uint16)
        for f, bound in splits:
            leaf = leaf * 2 + (columns[f] > bound)
        return leaf

    def probabilities(self, columns: np.ndarray) -> np.ndarray:
        score = np.full(columns.shape[1], self.base)
        for splits, values in self.trees:
            score += values[self.leaves(columns, splits)]
        return 1 / (1 + np.exp(-score))

    def gradients(self, columns: np.ndarray, positive: np.ndarray, total: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
        """Sums of first and second derivatives per feature, leaf under ``splits`` and value, in steps of 1 / SCALE."""
        p = self.probabilities(columns)
        g, h = np.rint((positive - total * p) * SCALE), np.rint(total * p * (1 - p) * SCALE)
        leaf, size = self.leaves(columns, splits).astype(np.int64) * self.bins, self.bins << len(splits)
        sums = np.array([[np.bincount(leaf + c, v, size) for c in columns] for v in (g, h)])
        return sums.astype(np.int64).reshape(2, len(columns), -1, self.bins)

    def grow(self, positive: int, total: int, gradients: Callable[[list[tuple[int, int]]], np.ndarray]) -> Boosted:
        """All trees, from the sums that ``gradients`` gives over all examples for the trees so far and the splits of the next one."""
        mean = min(max(positive / total, 1e-3), 1 - 1e-3)
        self.base = math.log(mean / (1 - mean))
        for _ in range(self.rounds):
            splits: list[tuple[int, int]] = []
            for _ in range(self.depth):
                gl, hl = np.cumsum(gradients(splits), 3) / SCALE
                gr, hr = gl[:, :, -1:] - gl, hl[:, :, -1:] - hl
                gain = (gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge)).sum(1)
                f, bound = divmod(int(gain.argmax()), self.bins)
                splits.append((f, bound))
            g, h = (np.stack([left[f, :, bound], right[f, :, bound]], 1).ravel() for left, right in ((gl, gr), (hl, hr)))
            self.trees.append((splits, self.rate * g / (h + self.ridge)))
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        columns, total = self.columns(x), np.ones(len(y))
        return self.grow(int(y.sum()), len(y), lambda splits: self.gradients(columns, y, total, splits))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(self.columns(x))


def fresh(kind: str, span: str, r: random.Random) -> str:
    """The span with other digits of the same kind: the leading digit and the layout stay, check digits hold."""
    if kind == "ip":
        return ".".join(str(r.randrange(1, 256)) for _ in range(4))
    at = [i for i, c in enumerate(span) if c.isdigit()]
    new = list(span)
    for i in at[1:] if kind != "email" else at:
        new[i] = r.choice("0123456789")
    if kind == "card":
        new[at[-1]] = next(d for d in "0123456789" if luhn("".join([*(new[i] for i in at[:-1]), d])))
    return "".join(new)


def rewritten(kind: str, span: str, r: random.Random) -> list[tuple[str, str, str]]:
    """(before, new form, after) of a base span: forms the strict patterns miss, alone or run together with other digits."""
    digits = "".join(c for c in span if c.isdigit())
    if kind == "email":
        name, _, host = span.partition("@")
        return [("", name + a + host.replace(".", d), "") for a, d in ((" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", "."))]
    if kind == "ip":
        return [("", span.replace(".", "[.]"), ""), ("", span.replace(".", "(.)"), ""), ("", span.replace(".", " . "), "")]
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [
            ("", ".".join(fours), ""), ("", digits, f" {digits}"), (f"{digits} ", digits, ""), (f"{r.randrange(10, 9999)} ", digits, ""), ("", digits, f" {r.randrange(10, 9999)}"),
            (f"{r.randrange(10, 9999)} ", "-".join(fours), ""), ("", " ".join(fours), f" {r.randrange(10, 999)}"),
        ]
    area, mid, last, front = digits[-10:-7], digits[-7:-4], digits[-4:], digits[:-10]
    if len(area) < 3:
        return []
    ip = ".".join(str(r.randrange(1, 256)) for _ in range(4))
    number = str(r.randrange(10**15, 10**16))
    return [
        ("", f"({area}) {mid}-{last}", ""), ("", f"{area}-{mid}-{last}", ""), ("", f"{area}.{mid}.{last}", ""), ("", f"{front or 1}-{area}-{mid}-{last}", ""),
        ("", f"00{front or 1} {area} {mid} {last}", ""), ("", span, f" {ip}"), ("", span, f" {number}"), (f"{number} ", span, ""), ("", f"{front or 1} ({area}) {mid}-{last}", ""),
    ]


def decoys(kind: str, span: str, r: random.Random) -> list[str]:
    """Numbers of the same look that are no personal data: wrong check digits, odd groups, dates, other lengths, bare runs."""
    digits = "".join(c for c in span if c.isdigit())
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + r.randrange(1, 10)) % 10)
        odd, left = [], digits
        while left:
            size = r.choice((1, 2, 3, 3, 4, 5, 6))
            odd, left = [*odd, left[:size]], left[size:]
        ragged = "".join(g + r.choice(" -.") for g in odd[:-1]) + odd[-1]
        return [wrong, "-".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), f"{wrong} {wrong}", ragged.replace(" ", ".", 1)]
    if kind == "phone":
        year, month, day = r.randrange(1900, 2100), r.randrange(1, 13), r.randrange(1, 29)
        run = "".join(r.choice("0123456789") for _ in range(r.randrange(7, 16)))
        return [run, f"{year}-{month:02}-{day:02}", f"{day}.{month}.{year}", f"{year}-{month:02}-{day:02} {r.randrange(24):02}", f"{run[:5]} {run[5:]}"]
    return []


def packed(text: str, kind: str, start: int, end: int) -> bytes:
    """The features of a candidate, a byte each."""
    return bytes(min(v, BINS - 1) for v in features(text, kind, start, end))


WIDTH = len(packed("0", "ip", 0, 1))


def unpacked(packs: list[bytes]) -> np.ndarray:
    """Columns of packed features."""
    return np.ascontiguousarray(np.frombuffer(b"".join(packs), np.uint8).reshape(-1, WIDTH).T)


def fold_of(span: str) -> int:
    """Spans of fold 0 of three are kept out of the fit."""
    return hashlib.md5(span.encode()).digest()[0] % 3


def copies(spans: int) -> int:
    """How often a base span is rewritten: few ones of a kind are repeated with fresh digits."""
    return max(1, min(8, FORMS // max(spans, 1)))


def examples(kind: str, text: str, start: int, end: int, times: int) -> Iterator[tuple[bytes, bool]]:
    """Packed features and label of the candidates that touch a base span, its rewritten forms and its decoys."""
    left, right, digest = text[:start], text[end:], hashlib.md5(text[start:end].encode()).digest()

    def learn(middle: str, mine: Iterable[Span] = ()) -> Iterator[tuple[bytes, bool]]:
        new = left + middle + right
        known = {k: set(v) for k, v in base_spans(new).items()}
        known[kind].update((start + s, start + e) for s, e in mine)
        for k, s, e in candidates(new):
            if s < start + len(middle) and e > start:
                yield packed(new, k, s, e), (s, e) in known[k]

    for i in range(times):
        r = random.Random(digest + bytes([i]))
        span = fresh(kind, text[start:end], r) if i else text[start:end]
        yield from learn(span)
        for before, form, after in rewritten(kind, span, r):
            at = len(before)
            mine = [(at, at + len(form))]
            if kind == "card" and before.strip() == form:
                mine.append((0, at - 1))
            elif kind == "card" and after.strip() == form:
                mine.append((at + len(form) + 1, at + len(form) + len(after)))
            yield from learn(before + form + after, mine)
        for form in decoys(kind, span, r):
            yield from learn(form)


def counted(rows: Iterable[tuple[bytes, int, bool]]) -> list[tuple[bytes, int, int, int]]:
    """(features, fold, positive ones, all ones) of the distinct (features, fold)."""
    found: dict[tuple[bytes, int], list[int]] = {}
    for x, fold, label in rows:
        n = found.setdefault((x, fold), [0, 0])
        n[0] += label
        n[1] += 1
    return [(*key, *n) for key, n in found.items()]


def fit(windows: list[tuple[str, str, int, int, bool]], precision: float) -> tuple[Boosted | None, list[float]]:
    """``fit_all`` on a list of windows (kind, text, start, end, is base), without Spark."""
    spans = Counter(w[0] for w in windows if w[4])

    def rows() -> Iterator[tuple[bytes, int, bool]]:
        for kind, text, start, end, base in windows:
            fold = fold_of(text[start:end])
            for x, label in examples(kind, text, start, end, copies(spans[kind])) if base else [(packed(text, kind, start, end), False)]:
                yield x, fold, label

    table = counted(rows())
    never = [2.0] * len(KINDS)
    train, held = ([r for r in table if (r[1] == 0) == out] for out in (False, True))
    positive, total = (np.array([r[i] for r in train], np.int64) for i in (2, 3))
    if not 0 < positive.sum() < total.sum():
        return None, never
    columns, model = unpacked([r[0] for r in train]), Boosted()
    model.grow(int(positive.sum()), int(total.sum()), lambda splits: model.gradients(columns, positive, total, splits))
    sums: dict[tuple[int, float], list[int]] = {}
    for (x, _, p, t), s in zip(held, model.probabilities(unpacked([r[0] for r in held])).tolist(), strict=True):
        n = sums.setdefault((x[0], s), [0, 0])
        n[0], n[1] = n[0] + p, n[1] + t
    for k in range(len(KINDS)):
        right, seen, mine = 0, 0, sorted((-s, *n) for (kind, s), n in sums.items() if kind == k)
        for i, (s, p, t) in enumerate(mine):
            right, seen = right + p, seen + t
            if s <= -0.5 and right / seen >= precision:
                never[k] = (-s + (-mine[i + 1][0] if i + 1 < len(mine) else 0.5)) / 2
    return model, never


def apart(spans: list[Span], start: int, end: int) -> bool:
    """Whether ascending, disjoint ``spans`` leave start..end free."""
    at = bisect_right(spans, (start, math.inf))
    return (at == 0 or spans[at - 1][1] <= start) and (at == len(spans) or spans[at][0] >= end)


def merged(spans: list[Span]) -> list[Span]:
    """Ascending, disjoint spans that cover the same places."""
    out: list[Span] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def windows_of(docs: DataFrame) -> DataFrame:
    """The distinct windows of all base spans, and of all candidates that overlap none as features, fold and digest."""
    types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
    names = ["kind", "window", "start", "end", "x", "fold", "digest"]

    def batch(rows: Iterable[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def read(batches):
        for b in slices(batches, 500):
            rows: dict[tuple, None] = {}
            for text in b.column(0).to_pylist():
                base = base_spans(text)
                taken = merged([x for v in base.values() for x in v])
                for k, s, e in ((k, s, e) for k, v in base.items() for s, e in v):
                    low = max(0, s - 2 * CONTEXT)
                    rows[k, text[low : e + 2 * CONTEXT], s - low, e - low, None, None, None] = None
                for k, s, e in candidates(text):
                    if apart(taken, s, e):
                        low = max(0, s - 2 * CONTEXT)
                        digest = hashlib.md5(f"{s - low}:{e - low}:{text[low : e + 2 * CONTEXT]}".encode()).digest()
                        rows[k, None, None, None, packed(text, k, s, e), fold_of(text[s:e]), digest] = None
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows.clear()
            yield batch(rows)

    return docs.mapInArrow(read, "kind string, window string, start int, end int, x binary, fold int, digest binary").distinct()


def examples_of(windows: DataFrame, spans: dict[str, int]) -> DataFrame:
    """Distinct examples of all windows: features, fold, positive ones, all ones."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, bool]]:
        for kind, window, start, end, x, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if window is None:
                yield x, fold, False
                continue
            fold = fold_of(window[start:end])
            for x, label in examples(kind, window, start, end, copies(spans[kind])):
                yield x, fold, label

    def make(batches):
        for b in slices(batches, 1000):
            columns = list(zip(*counted(rows(b)), strict=True)) or [[]] * 4
            types = (pa.binary(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["x", "fold", "positive", "total"])

    made = windows.select("kind", "window", "start", "end", "x", "fold").mapInArrow(make, "x binary, fold int, positive bigint, total bigint")
    return made.groupBy("x", "fold").agg(F.sum("positive").alias("positive"), F.sum("total").alias("total"))


def columns_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpacked(batch.column(0).to_pylist()), batch.column(1).to_numpy(), batch.column(2).to_numpy()


def gradients_of(train: DataFrame, model: Boosted, splits: list[tuple[int, int]], summed: bool) -> np.ndarray:
    """``model.gradients`` over all rows of ``train``: a task hands on one sum per feature, leaf and value that it met."""
    shape = (2, WIDTH, 1 << len(splits), model.bins)

    def add(batches):
        sums = np.zeros(shape, np.int64)
        for b in batches:
            if b.num_rows:
                sums += model.gradients(*columns_of(b), splits)
        g, h = sums.reshape(2, -1)
        met = np.flatnonzero((g != 0) | (h != 0))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(g[met]), pa.array(h[met])], names=["cell", "g", "h"])

    parts = train.mapInArrow(add, "cell bigint, g bigint, h bigint")
    if summed:
        parts = parts.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    found, sums = parts.toArrow(), np.zeros((2, math.prod(shape[1:])), np.int64)
    for i, name in enumerate(("g", "h")):
        np.add.at(sums[i], found["cell"].to_numpy(), found[name].to_numpy())
    return sums.reshape(shape)


def thresholds_of(held: DataFrame, model: Boosted, precision: float) -> list[float]:
    """Per kind the middle between the least score at which precision holds and the next one below; 2 if there is none."""

    def score(batches):
        for b in batches:
            if b.num_rows:
                columns, positive, total = columns_of(b)
                arrays = [pa.array(columns[0], pa.int32()), pa.array(model.probabilities(columns)), pa.array(positive), pa.array(total)]
                yield pa.RecordBatch.from_arrays(arrays, names=["kind", "score", "positive", "total"])

    sums = [F.sum("positive").alias("positive"), F.sum("total").alias("total")]
    scores = settle(held.mapInArrow(score, "kind int, score double, positive bigint, total bigint").groupBy("kind", "score").agg(*sums))
    # running sums over buckets of scores, then inside each bucket
    top = scores.where("score >= 0.5").withColumn("bucket", F.floor(-64 * F.log(1 - F.col("score") + 1e-12)))
    before = Window.partitionBy("kind").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    above = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_above") for c in ("positive", "total")]
    offsets = top.groupBy("kind", "bucket").agg(*sums).select("kind", "bucket", *above)
    inside = Window.partitionBy("kind", "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    right, seen = (F.col(f"{c}_above") + F.sum(c).over(inside) for c in ("positive", "total"))
    reached = top.join(offsets, ["kind", "bucket"]).select("kind", "score", (right / seen).alias("precision")).where(F.col("precision") >= precision)
    least = {r[0]: r[1] for r in reached.groupBy("kind").agg(F.min("score")).collect()}
    out = [2.0] * len(KINDS)
    for k, s in least.items():
        below = scores.where((F.col("kind") == k) & (F.col("score") < s)).agg(F.max("score")).first()[0]
        out[k] = (s + (0.5 if below is None else below)) / 2
    return out


def fit_all(docs: DataFrame, precision: float) -> tuple[Boosted | None, list[float]]:
    """The trees from all windows of all texts, and a threshold per kind, calibrated on the third of the spans that the trees have not seen."""
    windows = settle(windows_of(docs))
    sizes = windows.groupBy("kind", F.col("window").isNotNull().alias("base")).count().collect()
    spans, n = {r[0]: r[2] for r in sizes if r[1]}, sum(r[2] for r in sizes)
    if not spans:
        return None, [2.0] * len(KINDS)
    table = settle(examples_of(windows.repartition(-(-n // WINDOWS_PER_TASK)), spans).repartition(-(-n // WINDOWS_PER_FILE)))
    train, held = (table.where(c).select("x", "positive", "total") for c in ("fold <> 0", "fold = 0"))
    positive, total = train.agg(F.sum("positive"), F.sum("total")).first()
    if not 0 < (positive or 0) < (total or 0):
        return None, [2.0] * len(KINDS)
    model = Boosted()
    train.persist()
    summed = train.rdd.getNumPartitions() > TASKS_SUMMED
    model.grow(positive, total, lambda splits: gradients_of(train, model, splits, summed))
    train.unpersist()
    return model, thresholds_of(held, model, precision)


def find(docs: DataFrame, precision: float = 0.99, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans as kind:start:end in code points."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model, thresholds = fit_all(source.select("text"), precision)
    kind = source.schema["id"].dataType.simpleString()
    schema = pa.schema([(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def added(texts: list[str], bases: list[dict]) -> list[list[tuple[str, int, int]]]:
        asked = [(i, c) for i, t in enumerate(texts) for c in candidates(t)] if model else []
        out: list[list] = [[] for _ in texts]
        if not asked:
            return out
        score = model.predict(np.array([features(texts[i], *c) for i, c in asked], np.int64))
        bound = np.array([thresholds[KINDS.index(c[0])] for _, c in asked])
        kept = [(i, -s, c[1], -c[2], c) for (i, c), s, t in zip(asked, score, bound, strict=True) if s >= t]
        taken: dict[int, list[Span]] = {}
        for i, _, _, _, c in sorted(kept):
            if i not in taken:
                taken[i] = merged([x for v in bases[i].values() for x in v])
            if apart(taken[i], c[1], c[2]):
                insort(taken[i], c[1:])
                out[i].append(c)
        return out

    def joined(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))

    def read(batches):
        for b in slices(batches, 200):
            texts = b.column(1).to_pylist()
            bases = [base_spans(t) for t in texts]
            more = added(texts, bases)
            out = []
            for base, new in zip(bases, more, strict=True):
                strict = [(k, s, e) for k in KINDS for s, e in base[k]]
                out.append((*(len(base[k]) for k in KINDS), hashlib.sha256(joined(strict).encode()).hexdigest(), joined(strict + new), len(new)))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, schema.types, strict=True))], names=["id", *schema.names])

    sql = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return source.mapInArrow(read, f"id {kind}, {sql}").withColumnRenamed("id", id_col)
