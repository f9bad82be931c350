"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, the largest response of each filter feeds a softmax.
All widths are one matrix product: a narrower filter has zero weights for the bytes it does not see. The network is fitted on
a bounded sample of labelled windows; it is applied to every window of every text, and a text's probabilities are the mean
over its windows weighted by their bytes.

A text has as many windows as its bytes need; they go through the network in batches of fixed size, so length costs time only. Samples
with equal hashes are ordered by their windows. An empty table gives no rows, and without learned values every
prediction is ``und``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass(frozen=True)
class ConvSettings:
    window: int = 256  # bytes
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16  # of each width
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    per_label: int = 800  # different labelled texts, one window of each: the bound of the training sample
    seed: int = 7


@dataclass
class ByteConv:
    """Parameters: byte vectors, filters over the widest span, and the softmax layer."""

    labels: list[str]
    settings: ConvSettings = field(default_factory=ConvSettings)

    def __post_init__(self):
        s, r = self.settings, np.random.default_rng(self.settings.seed)
        self.span, n = max(s.widths), s.filters * len(s.widths)
        self.mask = np.zeros((self.span, s.embedding, n), dtype=np.float32)
        for i, w in enumerate(s.widths):
            self.mask[:w, :, i * s.filters : (i + 1) * s.filters] = 1
        self.mask = self.mask.reshape(self.span * s.embedding, n)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.parameters = {
            "embed": normal(256, s.embedding, scale=0.5), "filters": normal(self.span * s.embedding, n, scale=0.2) * self.mask,
            "bias": np.zeros(n, np.float32), "out": normal(n, len(self.labels), scale=0.1), "out_bias": np.zeros(len(self.labels), np.float32),
        }

    def spans(self, codes: np.ndarray) -> np.ndarray:
        """Byte windows (n, window) as the bytes under the widest filter at every place: (n, places, span)."""
        return np.lib.stride_tricks.sliding_window_view(codes, self.span, axis=1)

    def forward(self, codes: np.ndarray) -> tuple:
        p = self.parameters
        under = self.spans(codes)
        x = p["embed"][under].reshape(-1, p["filters"].shape[0])
        response = (x @ p["filters"]).reshape(len(codes), under.shape[1], -1)
        top = response.argmax(axis=1)
        pooled = np.take_along_axis(response, top[:, None, :], axis=1)[:, 0, :] + p["bias"]
        hidden = np.maximum(pooled, 0)
        logits = hidden @ p["out"] + p["out_bias"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), hidden, top, under

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Softmax of windows; only maxima of responses are kept."""
        p = self.parameters
        out = []
        for at in range(0, len(codes), 128):
            under = self.spans(codes[at : at + 128])
            x = p["embed"][under].reshape(-1, p["filters"].shape[0])
            pooled = (x @ p["filters"]).reshape(len(under), under.shape[1], -1).max(axis=1) + p["bias"]
            logits = np.maximum(pooled, 0) @ p["out"] + p["out_bias"]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(out)

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy. A pooled response passes its gradient to the place of its maximum alone."""
        p, s = self.parameters, self.settings
        prob, hidden, top, under = self.forward(codes)
        n = len(codes)
        delta = prob
        delta[np.arange(n), target] -= 1
        delta /= n
        back = (delta @ p["out"].T) * (hidden > 0)
        chosen = under[np.arange(n)[:, None], top]  # (n, filters, span)
        vectors = p["embed"][chosen].reshape(n, back.shape[1], -1)
        filters = np.einsum("nf,nfk->kf", back, vectors) * self.mask
        flow = (back[:, :, None] * p["filters"].T[None]).reshape(-1, s.embedding)
        embed = np.zeros_like(p["embed"])
        np.add.at(embed, chosen.reshape(-1), flow)
        return {"embed": embed, "filters": filters, "bias": back.sum(axis=0), "out": hidden.T @ delta, "out_bias": delta.sum(axis=0)}

    def fit(self, codes: np.ndarray, target: np.ndarray) -> None:
        """Adam over shuffled batches."""
        s, r = self.settings, np.random.default_rng(self.settings.seed + 1)
        first = {k: np.zeros_like(v) for k, v in self.parameters.items()}
        second = {k: np.zeros_like(v) for k, v in self.parameters.items()}
        t = 0
        for _ in range(s.epochs):
            order = r.permutation(len(codes))
            for at in range(0, len(order), s.batch):
                t += 1
                take = order[at : at + s.batch]
                for k, g in self.gradients(codes[take], target[take]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    step = s.rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                    self.parameters[k] = (self.parameters[k] - step).astype(np.float32)


def cut(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, padded with zero bytes; how many windows each text has; bytes in each window."""
    counts = np.array([max(1, -(-len(t) // window)) for t in texts])
    data = np.frombuffer(b"".join(t.ljust(int(c) * window, b"\0") for t, c in zip(texts, counts, strict=True)), dtype=np.uint8)
    sizes = np.full(int(counts.sum()), window)
    sizes[np.cumsum(counts) - 1] = [len(t) - (int(c) - 1) * window for t, c in zip(texts, counts, strict=True)]
    return data.reshape(-1, window), counts, sizes


def train(labelled: DataFrame, settings: ConvSettings = ConvSettings()) -> ByteConv | None:
    """Fit on one window of at most ``per_label`` different texts per label. ``labelled``: text, label. None without any usable row.

    Which texts and which of their windows are taken depends on a hash of the text alone. Copies of a text count once.
    """
    h = F.xxhash64("text")
    first = Window.partitionBy("label").orderBy("h", "part")
    usable = labelled.where(F.col("label").isNotNull() & F.col("text").rlike("\\p{L}")).withColumn("h", h)
    start = F.pmod(F.shiftright("h", 8), F.greatest(F.length("text") - settings.window, F.lit(1))).cast("int") + 1
    parts = usable.select("label", "h", F.substring("text", start, F.lit(settings.window)).alias("part")).distinct()
    rows = parts.withColumn("n", F.row_number().over(first)).where(F.col("n") <= settings.per_label).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["label"], r["h"]))
    labels = sorted({r["label"] for r in rows})
    net = ByteConv(labels, settings)
    codes = np.stack([np.frombuffer(r["part"].encode()[: settings.window].ljust(settings.window, b"\0"), dtype=np.uint8) for r in rows])
    net.fit(codes, np.array([labels.index(r["label"]) for r in rows]))
    return net


def identify(
    docs: DataFrame, held_out: Column, settings: ConvSettings = ConvSettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang"
) -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score`` (probability of the prediction).

    Only the texts for which ``held_out`` is not true are learnt from, and of them those with a label. Null and empty texts and texts
    without a letter get ``und`` and score 0, as everything does if there was nothing to learn from. Labels are the only other column
    read; repeated rows, null ids and further columns do no harm. Predictions depend on the text alone.
    """
    source = docs.select(
        F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"), F.col(label_col).alias("label")
    )
    kind = source.schema["id"].dataType.simpleString()
    net = train(source.where(~F.col("held_out")).select("text", "label"), settings)

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if net is not None and t and LETTER.search(t)]
            for at in range(0, len(known), 200):
                part = known[at : at + 200]
                codes, counts, sizes = cut([texts[i].encode() for i in part], settings.window)
                weighted = net.probabilities(codes) * sizes[:, None]
                ends = np.cumsum(counts)
                mean = np.add.reduceat(weighted, ends - counts, axis=0)
                mean /= mean.sum(axis=1, keepdims=True)
                for i, m in zip(part, mean, strict=True):
                    labels[i], scores[i] = net.labels[int(m.argmax())], min(1.0, float(m.max()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    out = source.select("id", "held_out", "text").mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
