"""Toxicity after noisy-channel deobfuscation.

A token that mixes letters with look-alike characters, spreads its letters out or repeats them is a noisy form of a word. Its
characters become a lattice: a letter stands for itself, a look-alike for the letters it imitates, a separator or a repeated
letter may stand for nothing. Viterbi search finds the cheapest path under a character trigram model of the corpus and the
costs of the channel. The restored words of a text, whole and by their first letters, are the features of a logistic model.

Trigram counts are taken over all texts; their table is bounded by the alphabet. The logistic model is fitted on a
bounded sample of labelled texts. Restored tokens are remembered per Python worker in dictionaries of bounded size.

A text is read whole, token by token; what is held beside it are its distinct features, and a lattice is as long as one token. Empty
tables of documents give no rows; without labels of both kinds all scores are 0. Of equally cheap paths the first in the order of the search stays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramspark.llm.shared import settle

# fixed values: look-alike characters and the letters they imitate
LOOK_ALIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i", "*": "aeiou",
}
SEPARATORS = frozenset(" .-_*·~'/")
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
SYMBOL = {c: i + 1 for i, c in enumerate(LETTERS)}  # 0: outside a word; the last one: any other letter
OTHER = len(LETTERS) + 1
SIZE = 64

SPREAD = re.compile(r"(?<!\S)(?:\w[ .\-_*~/]{1,2}){3,}\w(?!\w)")
TRIPLE = re.compile(r"(\w)\1\1")
EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…#%&*$|=-_/~"
PLAIN_EDGES = "".join(c for c in EDGES if c not in LOOK_ALIKE)
CACHED_TOKENS = 600_000


def symbol_table() -> np.ndarray:
    """Symbol of every code point below 0x250, case folded."""
    table = np.zeros(0x250, dtype=np.int32)
    for code in range(0x250):
        c = chr(code).lower()
        if c.isalpha():
            table[code] = SYMBOL.get(c, OTHER)
    return table


def trigram_counts(texts: Iterable[str]) -> np.ndarray:
    """Counts of symbol trigrams inside words, SIZE^3 of them; a word is preceded by two outside symbols."""
    table, counts = symbol_table(), np.zeros(SIZE**3, dtype=np.int64)
    for text in texts:
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        s = np.where(codes < 0x250, table[np.minimum(codes, 0x24F)], OTHER)
        before = np.concatenate([[0], s[:-1]]) if len(s) else s
        earlier = np.where(before == 0, 0, np.concatenate([[0], before[:-1]])) if len(s) else s
        key = (earlier * SIZE + before) * SIZE + s
        counts += np.bincount(key[(s > 0) | (before > 0)], minlength=SIZE**3)
    return counts


@dataclass
class CharModel:
    """Interpolated trigram model: cost (negative natural logarithm) of a symbol after two others."""

    counts: np.ndarray

    def __post_init__(self):
        three = self.counts.reshape(SIZE, SIZE, SIZE).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        p3 = (three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)
        self.cost = -np.log(p3)


def options(token: str, i: int) -> list[tuple[str, float]]:
    """What the character at place i may stand for, with the channel's cost."""
    c = token[i]
    out = []
    if c.isalpha():
        out.append((c, 0.0))
        if i and token[i - 1] == c:
            long = i > 1 and token[i - 2] == c or i + 1 < len(token) and token[i + 1] == c
            out.append(("", 0.3 if long else 6.0))
    else:
        out += [(x, 1.0 + 0.7 * (len(LOOK_ALIKE[c]) > 2)) for x in LOOK_ALIKE.get(c, "")]
        if c in SEPARATORS or not out:
            out.append(("", 1.0))
        elif c == "!":
            out.append(("", 3.0))
    return out


def decode(token: str, model: CharModel) -> str:
    """Cheapest reading of a token: Viterbi search, the states being the last two symbols of the reading."""
    cost = model.cost
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for i in range(len(token)):
        step = options(token, i)
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (c, path) in states.items():
            for letter, channel in step:
                if letter:
                    s = SYMBOL.get(letter, OTHER)
                    key, total, way = (b, s), c + channel + cost[a, b, s], (path, letter)
                else:
                    key, total, way = (a, b), c + channel, path
                if key not in new or total < new[key][0]:
                    new[key] = (total, way)
        states = new
    path = min(((c + cost[a, b, 0], path) for (a, b), (c, path) in states.items()), key=lambda x: x[0])[1]
    out = []
    while path:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


def restored(token: str, model: CharModel) -> str:
    """The word that a lower-case token without white space stands for; empty if it has no letter."""
    word = token.strip(EDGES)
    if word.isalpha() and not TRIPLE.search(word):
        return word
    noisy = token.lstrip("\"'([{<«“‘").rstrip(".,;:?\"')]}>»”’…#%&=")
    return decode(noisy, model) if any(map(str.isalpha, noisy)) else ""


def readings(token: str, model: CharModel) -> list[str]:
    """The words that a lower-case token without white space may stand for; none if it has no letter.

    Look-alikes at an edge may belong to the word or be marks beside it, so the token is read with and without those of each edge.
    """
    first = restored(token, model)
    if not first:
        return []
    word = token.strip(EDGES)
    front, back = token.partition(word)[::2]
    front, back = front.lstrip(PLAIN_EDGES), back.rstrip(PLAIN_EDGES)
    if not front and not back:
        return [first]
    others = (decode(a + word + b, model) for a in dict.fromkeys(("", front)) for b in dict.fromkeys(("", back)) if a or b or not word.isalpha())
    return list(dict.fromkeys([first, *filter(None, others)]))


def restore_text(text: str, model: CharModel) -> str:
    """All readings of the words of a text; letters spread over single characters come as a word at the end."""
    low = text.lower()
    words = [w for t in low.split() for w in readings(t, model)]
    words += [decode(m[0], model) for m in SPREAD.finditer(low)]
    return " ".join(w for w in words if w)


def word_features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in (4, 5, 6) if len(word) >= n)]


class TextFeatures(dict):
    """Token -> what ``value`` makes of each of its readings, remembered; starts anew when full."""

    def __init__(self, model: CharModel, value):
        super().__init__()
        self.model, self.value = model, value

    def __missing__(self, token: str):
        v = tuple(map(self.value, readings(token, self.model)))
        if len(token) <= 64:
            if len(self) >= CACHED_TOKENS:
                self.clear()
            self[token] = v
        return v

    def of(self, text: str) -> set:
        """Distinct values in a text."""
        low = text.lower()
        found = set(chain.from_iterable(map(self.__getitem__, set(low.split()))))
        found.update(self.value(decode(m[0], self.model)) for m in SPREAD.finditer(low))
        return found


@dataclass
class ToxicModel:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, features: Iterable[str]) -> float:
        z = self.bias + sum(self.weights[f] for f in features)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model with squared penalty, by Nesterov's accelerated gradients; weights are not negative.

    Features were chosen as signs of the label 1, so a negative weight would only unlearn another feature.
    """
    n, m = x.shape
    w, v, bias, vb = np.zeros(m), np.zeros(m), 0.0, 0.0
    rate = 4.0 / max(1.0, float((x.sum(axis=1) + 1).mean()))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ v + vb, -30, 30)))
        new = np.maximum(0, v - rate * (x.T @ (p - y) / n + penalty / n * v))
        new_bias = vb - rate * float((p - y).mean())
        k = (t - 1) / (t + 2)
        v, vb = new + k * (new - w), new_bias + k * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


def train(labelled: DataFrame, model: CharModel, features: int = 1500) -> ToxicModel | None:
    """Logistic model over signs of the label 1. ``labelled``: key, text, label (bounded by the caller). None without both labels."""

    def run(batches):
        own = TextFeatures(model, lambda w: w)
        for b in batches:
            rows, names = [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                found = {f for w in own.of(text or "") if w for f in word_features(w)}
                rows += [row] * len(found)
                names += found
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(names, pa.string())], names=["key", "label", "feature"])

    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    found = settle(labelled.mapInArrow(run, "key bigint, label int, feature string"))
    rate = (F.col("ones") + 0.5) / sizes[1] / ((F.col("zeros") + 0.5) / sizes[0])
    counts = found.groupBy("feature").agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros"))
    signs = counts.where(F.col("ones") >= 3).withColumn("rate", rate).where("rate >= 4").withColumn("gain", F.col("ones") * F.log("rate"))
    chosen = [r["feature"] for r in signs.orderBy(F.desc("gain"), "feature").limit(features).collect()]
    place = {f: i for i, f in enumerate(chosen)}
    picked = found.where(F.col("feature").isin(chosen)) if chosen else found.limit(0)
    rows = picked.groupBy("key").agg(F.sort_array(F.collect_list("feature")).alias("features")).collect()
    ids = {r["key"]: r["features"] for r in rows}
    y = labelled.select("key", "label").orderBy("key").collect()
    x = np.zeros((len(y), len(chosen)), dtype=np.float32)
    for i, r in enumerate(y):
        x[i, [place[f] for f in ids.get(r["key"], ())]] = 1
    w, bias = fit_logistic(x, np.array([r["label"] for r in y], dtype=float))
    return ToxicModel(bias, {f: float(v) for f, v in zip(chosen, w, strict=True) if v > 1e-3})


def char_model(texts: DataFrame) -> CharModel:
    """Trigram counts over all ``text``; the result has at most SIZE^3 rows."""

    def run(batches):
        counts = np.zeros(SIZE**3, dtype=np.int64)
        for b in batches:
            counts += trigram_counts(t for t in b.column(0).to_pylist() if t)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["gram", "n"])

    counts = np.zeros(SIZE**3, dtype=np.int64)
    for r in texts.select("text").mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    return CharModel(counts)


def toxicity(
    docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if score >= 0.5).

    ``labels`` has the id and the label 0 or 1; null labels are left out, of several labels of an id the larger counts. At most
    ``sample`` texts of each label are learnt from, those with the smallest hash of their id, and none for whose id ``held_out`` is
    true; of several rows of an id, the text with the smallest hash. Null and empty texts get the score of a text without signs; without labels of both kinds every score is 0. A
    score depends on the text alone. Repeated rows, null ids and further columns do no harm.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    chars = char_model(source)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    once = known.groupBy("id").agg(F.max("label").alias("label")).where(~F.coalesce(held_out(F.col("id")), F.lit(False)))
    first = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    picked = settle(once.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("id", "label"))
    # at most 2 * sample ids: small enough to go to every task, so texts need no shuffle
    found = source.where("NOT held_out").join(F.broadcast(picked), "id").groupBy("id").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("one"))
    labelled = found.select("one.text", "one.label").withColumn("key", F.monotonically_increasing_id())
    toxic = train(settle(labelled.select("key", "text", "label")), chars)

    def run(batches):
        score = _scorer(chars, toxic)
        for b in batches:
            scores = [score(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["id", "held_out", "score", "predicted"],
            )

    return source.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def _scorer(chars: CharModel, toxic: ToxicModel | None):
    if toxic is None:
        return lambda text: 0.0
    weights = toxic.weights
    own = TextFeatures(chars, lambda w: tuple(f for f in word_features(w) if f in weights) if w else ())
    return lambda text: toxic.score({f for signs in own.of(text) for f in signs})
