"""Quality of documents by attention-based multiple-instance learning over their passages.

A document is a bag of passages of ``PASSAGE`` words, and only the bag has a label.  Every
passage becomes a vector of features (shares of byte classes, word shapes, repeated words, and
signed hashed words) and is encoded by a learned layer, ``h = tanh(x E + e)``.  A learned gate
weighs the passages, ``softmax over the bag of ((tanh(h V) * sigmoid(h U)) w)``, and the weighted
mean of the encodings is scored by a logistic layer.  All layers are trained together on document
labels, so the weights say which passage decided: ``top_passage`` and ``top_weight``.

Training uses a bounded sample: at most ``per_label`` documents of either label, chosen by hash
from all labelled ones, and of a document at most ``TRAIN_PASSAGES`` passages spread evenly over
its whole text.  Scores read every passage of every text.

Defined results: null, empty and blank texts are a bag of one passage without words; very long
texts are scored in blocks of passages; rows of one id, and repeated rows, are scored by their own
texts, and all of them learn that id's label, which is the mean of its label rows; null ids and
labels that are neither 0 nor 1 are not learned from; without any label every score is 0.5.  An
empty table gives an empty result; only the named columns are read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.llm.words import Words, chunks, trimmed

PASSAGE = 64
#: documents of either label, and passages of a document, that training sees at most
PER_LABEL, TRAIN_PASSAGES = 1500, 64
HASHED, HIDDEN, GATE = 128, 24, 12
EPOCHS, BATCH, STEP, DECAY = 12, 32, 0.01, 1e-4
#: passages encoded together
_BLOCK = 4096


def _byte_classes() -> np.ndarray:
    """0 blanks, 1 to 3 lower, upper, digits, one class for each other ASCII sign, then controls, leads and other bytes."""
    c = np.full(256, 36, np.uint8)
    c[[0x20, *range(0x09, 0x0E)]] = 0
    c[97:123], c[65:91], c[48:58] = 1, 2, 3
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    c[signs] = np.arange(4, 4 + len(signs))
    c[0xC0:], c[0x80:0xC0] = 37, 38
    return c


_CLASS = _byte_classes()
_CLASSES = 39
#: word length, distinct share, share repeating the word before, share seen earlier in the document, and fill
_SHAPES = 5
FEATURES = _CLASSES - 1 + _SHAPES + HASHED


def _seen_before(w: Words) -> np.ndarray:
    """Whether the pair of a word and the next one occurred earlier in the same document."""
    n = len(w.hash)
    doc = np.repeat(np.arange(len(w.offset) - 1), np.diff(w.offset))
    pair = w.hash * np.uint64(3) + np.roll(w.hash, -1) * np.uint64(5) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(pair, kind="stable")
    again = np.zeros(n, bool)
    again[order[1:]] = pair[order[1:]] == pair[order[:-1]]
    last = w.offset[1:][np.diff(w.offset) > 0] - 1
    again[last] = False
    return again


def _cuts(w: Words, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-end word of every passage, and documents + 1 offsets into the passages."""
    n = np.diff(w.offset)
    count = np.maximum(1, -(-n // PASSAGE))
    taken = count if most is None else np.minimum(count, most)
    offset = np.concatenate([[0], np.cumsum(taken)])
    k = np.arange(offset[-1]) - np.repeat(offset[:-1], taken)
    k = k * np.repeat(count, taken) // np.repeat(taken, taken)  # evenly spread
    start = np.repeat(w.offset[:-1], taken) + k * PASSAGE
    return start, np.minimum(start + PASSAGE, np.repeat(w.offset[1:], taken)), offset


def _features(w: Words, again: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Features of passages of words a to b, which ascend and do not overlap."""
    rows, size = len(a), b - a
    x = np.zeros((rows, FEATURES), np.float32)
    if not size.sum():
        return x
    full = np.flatnonzero(size)
    word = np.repeat(a[full] - np.concatenate([[0], np.cumsum(size[full])[:-1]]), size[full]) + np.arange(size.sum())
    row = np.repeat(full, size[full])
    first, last = w.start[a[full]], w.end[b[full] - 1]
    span = last - first
    byte = np.repeat(first - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
    kind = np.repeat(full * _CLASSES, span) + _CLASS[w.data[byte]]
    counts = np.bincount(kind, minlength=rows * _CLASSES).reshape(rows, _CLASSES)[:, 1:]
    bytes_ = counts.sum(axis=1)
    x[:, :_CLASSES - 1] = np.sqrt(counts / np.maximum(bytes_, 1)[:, None])

    h = w.hash[word]
    n = np.maximum(size, 1)
    key = (row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    distinct = np.bincount((np.unique(key) >> np.uint64(44)).astype(np.int64), minlength=rows)
    echo = np.zeros(len(word), bool)
    echo[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    at = _CLASSES - 1
    x[:, at] = np.log1p(bytes_ / n)
    x[:, at + 1] = distinct / n
    x[:, at + 2] = np.bincount(row, echo, rows) / n
    x[:, at + 3] = np.bincount(row, again[word], rows) / n
    x[:, at + 4] = size / PASSAGE
    slot = row * HASHED + (h % np.uint64(HASHED)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    x[:, at + _SHAPES:] = np.bincount(slot, sign, rows * HASHED).reshape(rows, HASHED) / np.sqrt(n)[:, None]
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Model(NamedTuple):
    """Layers; features are standardised by ``mean`` and ``scale``."""

    mean: np.ndarray
    scale: np.ndarray
    E: np.ndarray
    e: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    c0: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.E + self.e)

    def gate(self, h: np.ndarray) -> np.ndarray:
        return (np.tanh(h @ self.V) * _sigmoid(h @ self.U)) @ self.w

    def pool(self, h: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of bags of encoded passages, and the weight of every passage in its bag."""
        a = _weights(self.gate(h), offset)
        z = np.add.reduceat(a[:, None] * h, offset[:-1], axis=0)
        return _sigmoid(z @ self.c + self.c0[0]), a


def _weights(gate: np.ndarray, offset: np.ndarray) -> np.ndarray:
    size = np.diff(offset)
    a = np.exp(gate - np.repeat(np.maximum.reduceat(gate, offset[:-1]), size))
    return a / np.repeat(np.add.reduceat(a, offset[:-1]), size)


def gradients(m: Model, x: np.ndarray, offset: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of bags (standardised features) and its derivatives by every layer."""
    size = np.diff(offset)
    h = np.tanh(x @ m.E + m.e)
    t, s = np.tanh(h @ m.V), _sigmoid(h @ m.U)
    g = t * s
    a = _weights(g @ m.w, offset)
    z = np.add.reduceat(a[:, None] * h, offset[:-1], axis=0)
    p = _sigmoid(z @ m.c + m.c0[0])
    loss = float(-(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).mean())
    d = (p - y) / len(y)
    dz = np.repeat(d[:, None] * m.c, size, axis=0)
    da = (h * dz).sum(axis=1)
    dgate = a * (da - np.repeat(np.add.reduceat(a * da, offset[:-1]), size))
    dg = dgate[:, None] * m.w
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ m.V.T + ds @ m.U.T) * (1 - h * h)
    return loss, {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": g.T @ dgate, "c": z.T @ d, "c0": d.sum(keepdims=True)}


def train(x: np.ndarray, offset: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adam over batches of bags; equal input gives an equal model."""
    rng = np.random.Generator(np.random.PCG64(11))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-3, 1.0, scale)
    x = (x - mean) / scale

    def layer(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    m = Model(mean, scale, layer(x.shape[1], HIDDEN), np.zeros(HIDDEN), layer(HIDDEN, GATE), layer(HIDDEN, GATE), layer(GATE),
              layer(HIDDEN), np.zeros(1))
    layers = [f for f in Model._fields if f not in ("mean", "scale")]
    first, second = ({f: np.zeros_like(getattr(m, f)) for f in layers} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            bags = order[at:at + BATCH]
            part = np.concatenate([np.arange(offset[b], offset[b + 1]) for b in bags])
            cut = np.concatenate([[0], np.cumsum(offset[bags + 1] - offset[bags])])
            _, grad = gradients(m, x[part], cut, y[bags])
            step += 1
            moved = {}
            for f in layers:
                v = getattr(m, f)
                g = grad[f] + (DECAY * v if v.ndim == 2 else 0)
                first[f] = 0.9 * first[f] + 0.1 * g
                second[f] = 0.999 * second[f] + 0.001 * g * g
                moved[f] = v - STEP * (first[f] / (1 - 0.9 ** step)) / (np.sqrt(second[f] / (1 - 0.999 ** step)) + 1e-8)
            m = m._replace(**moved)
    return m._replace(**{f: np.asarray(getattr(m, f), np.float32) for f in Model._fields})


def bags(column: pa.Array, most: int | None = None) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words, repeats, passages' first and past-the-end words and document offsets, some whole documents at a time."""
    for w in chunks(column):
        a, b, offset = _cuts(w, most)
        yield w, _seen_before(w), a, b, offset


@trimmed
def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for w, again, a, b, offset in bags(batch.column("text"), TRAIN_PASSAGES):
            x = _features(w, again, a, b)
            found += [x[i:j].astype(np.float16).tobytes() for i, j in zip(offset[:-1], offset[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), pa.array(found, pa.binary())], names=["key", "y", "bag"])


def _trained(epochs: int):
    """One task: the bounded sample in, one model out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "y", "bag")))))
        if not rows:
            return
        x = [np.frombuffer(r[2], np.float16).reshape(-1, FEATURES) for r in rows]
        offset = np.concatenate([[0], np.cumsum([len(v) for v in x])])
        m = train(np.concatenate(x).astype(np.float32), offset, np.array([r[1] for r in rows]), epochs)
        yield pa.RecordBatch.from_arrays([pa.array(list(Model._fields)), pa.array([v.astype("<f4").tobytes() for v in m], pa.binary()),
                                          pa.array([list(v.shape) for v in m], pa.list_(pa.int64()))], names=["layer", "values", "shape"])

    return trimmed(run)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_label: int = PER_LABEL, epochs: int = EPOCHS) -> Model | None:
    """Learn from the documents that have a label; None if there are none."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y in (0, 1)")
    named = named.groupBy("id").agg(F.avg("y").alias("y")).join(texts.select("id").distinct(), "id", "left_semi").withColumn("good", F.expr("y >= 0.5"))
    # of either label an expected 2 * per_label ids by hash, whose size is known: they are broadcast
    counts = {r["good"]: r["n"] for r in named.groupBy("good").agg(F.count("*").alias("n")).collect()}
    range_ = float(1 << 30)
    key = F.pmod(F.xxhash64(F.lit(11), F.col("id").cast("string")), F.lit(1 << 30))
    below = F.when(F.col("good"), 2 * per_label * range_ / max(1, counts.get(True, 0))).otherwise(2 * per_label * range_ / max(1, counts.get(False, 0)))
    chosen = named.where(key < below)
    rows = texts.join(F.broadcast(chosen), "id").withColumn("key", F.xxhash64(F.lit(12), F.col("id").cast("string"), "text"))
    # an id may have any number of rows: a bounded number of them by hash
    first = F.row_number().over(Window.partitionBy("good").orderBy("key", "y"))
    sample = rows.withColumn("place", first).where(F.col("place") <= per_label).select("key", "y", "text")
    vectors = sample.mapInArrow(_sample, "key long, y double, bag binary")
    found = vectors.repartition(1).mapInArrow(_trained(epochs), "layer string, values binary, shape array<long>").collect()
    layers = {r["layer"]: np.frombuffer(r["values"], "<f4").reshape(r["shape"]) for r in found}
    return Model(**layers) if layers else None


def judged(model: Model, column: pa.Array) -> tuple[np.ndarray, ...]:
    """Score, passages, the passage of largest weight (the first such) and its weight, of every text."""
    out = []
    for w, again, a, b, offset in bags(column):
        h = np.concatenate([model.encode(_features(w, again, a[i:i + _BLOCK], b[i:i + _BLOCK])) for i in range(0, len(a), _BLOCK)])
        score, weight = model.pool(h, offset)
        size = np.diff(offset)
        most = np.maximum.reduceat(weight, offset[:-1])
        at = np.flatnonzero(weight == np.repeat(most, size))
        top = at[np.searchsorted(at, offset[:-1])] - offset[:-1]
        out.append((score, size, top, most))
    if not out:
        return (np.zeros(0),) * 4
    return tuple(np.concatenate(v) for v in zip(*out))


def _scored(model: Model, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, size, top, weight = judged(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(size, pa.int64()),
                 pa.array(top, pa.int64()), pa.array(weight, pa.float64())],
                names=[*carried, "score", "n_passages", "top_passage", "top_weight"])

    return trimmed(run)


def score(docs: DataFrame, model: Model | None, carry: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The carried columns, ``score`` (the probability of label 1), and the passage that weighed most."""
    names = [f"carry_{c}" for c in carry]
    rows = docs.select(F.col(text_col).alias("text"), *(c.alias(f"carry_{n}") for n, c in carry.items()))
    added = ["score", "n_passages", "top_passage", "top_weight"]
    if model is None:
        none = F.lit(None).cast("long")
        return rows.select(*names, F.lit(0.5), none, none, F.lit(None).cast("double")).toDF(*carry, *added)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*names).schema)
    kinds += "score double, n_passages long, top_passage long, top_weight double"
    return rows.mapInArrow(_scored(model, names), kinds).toDF(*carry, *added)
