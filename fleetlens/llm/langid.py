"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all learnable documents; the classifier is trained by
follow-the-regularised-leader with elastic-net penalties on a bounded, hash-random sample of
them (``per_language`` rows a language, each as a sparse vector of at most 2 ** BITS entries).
A temperature, fitted on every fifth row of the sample, which training does not see, calibrates its
probabilities.  Whole texts are nearly always right and say nothing about doubt, so the
temperature is fitted on short cuts of these rows: CUTS n-grams drawn from a row's own.
Every document is then scored on its whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every
text when nothing can be learned; ties go to the first language in code-point order; rows
without language are never learned from; repeated rows get the same prediction.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.scratch import Scratch
from fleetlens.llm.words import trimmed

BITS = 18
#: rows a language gives to training, and how often they are gone through
PER_LANGUAGE, EPOCHS = 1500, 3
#: follow-the-regularised-leader: step, its offset, and the L1 and L2 penalties
ALPHA, BETA, L1, L2 = 0.5, 1.0, 3e-3, 1e-4
#: scale of the term frequencies, which sum to 1
SCALE = 20.0
#: n-grams of the short cuts that the temperature is fitted on (three to a character), and how often each row is cut
CUTS, CUT_TIMES = (15, 30, 60, 120), 2
#: share of the target that the fit leaves to all languages alike, so that no temperature is too sure
SMOOTHING = 0.01
UNKNOWN = "und"
_SLICE_CHARS = 1 << 17
_FACTORS = [(0x9E3779B1,), (0x85EBCA6B, 0xC2B2AE35), (0x27D4EB2F, 0x165667B1, 0xD6E8FEB9)]
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _gram_slices(column: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, rows, for n = 1, 2, 3: feature of every n-gram and its row) of lower-cased letters and single spaces."""
    texts = column.to_pylist()
    i = 0
    while i < len(texts):
        j, size, part = i, 0, []
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= _SLICE_CHARS):
            part.append(" " + (texts[j] or "").lower() + " ")
            size += len(part[-1])
            j += 1
        c = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(j - i), [len(t) for t in part])
        letter = _is_letter()[c]
        keep = letter.copy()
        keep[0] = True
        keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
        c, row = np.where(letter, c, 32)[keep].astype(np.uint32), row[keep]
        grams = []
        for n, factors in enumerate(_FACTORS, 1):
            h = sum((c[k:len(c) - n + 1 + k] * np.uint32(f) for k, f in enumerate(factors)), np.uint32(n))
            h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
            last = row[n - 1:]
            same = last == row[:len(last)]
            if n == 1:
                same &= c != 32
            grams.append((h[same], last[same]))
        yield i, j - i, grams
        i = j


def _vectors(grams, rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and term frequencies of each row."""
    feature = np.concatenate([g[0] for g in grams]).astype(np.int64)
    row = np.concatenate([g[1] for g in grams])
    key, count = np.unique((row << BITS) | feature, return_counts=True)
    cut = np.searchsorted(key >> BITS, np.arange(rows + 1))
    return [(key[a:b] & ((1 << BITS) - 1), count[a:b] / max(1, count[a:b].sum())) for a, b in zip(cut[:-1], cut[1:])]


@trimmed
def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros((1 << BITS) + 1, np.int64)
    seen = np.zeros(1 << BITS, np.int64)
    for b in batches:
        for _, rows, grams in _gram_slices(b.column("text")):
            feature = np.concatenate([g[0] for g in grams])
            row = np.concatenate([g[1] for g in grams])
            feature = feature[np.argsort(row, kind="stable")]
            cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                f = feature[s:e]
                at = np.arange(len(f))
                seen[f] = at  # the last place of each feature
                df[f[seen[f] == at]] += 1
            df[-1] += rows
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["feature", "n"])


@trimmed
def _sample_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        feature, weight = [], []
        for _, rows, grams in _gram_slices(b.column("text")):
            for f, w in _vectors(grams, rows):
                feature.append(f.astype(np.int32).tobytes()), weight.append(w.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("key"), pa.array(feature, pa.binary()), pa.array(weight, pa.binary())],
                                         names=["lang", "key", "feature", "weight"])


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  #: features x languages, inverse document frequency included
    temperature: float

    def probabilities(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of every row, and whether it has a letter."""
        out, lettered = [], []
        for _, rows, grams in _gram_slices(column):
            logits = np.zeros((rows, len(self.languages)))
            size = np.zeros(rows)
            for feature, row in grams:
                if len(row):
                    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    logits[row[heads]] += np.add.reduceat(self.weights[feature], heads, axis=0)
                    size += np.bincount(row, minlength=rows)
            out.append(logits * (SCALE / np.maximum(size, 1))[:, None])
            lettered.append(np.bincount(grams[0][1], minlength=rows) > 0)
        logits = np.concatenate(out) if out else np.zeros((0, len(self.languages)))
        return _softmax(logits / self.temperature), np.concatenate(lettered) if lettered else np.zeros(0, bool)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True)) if x.size else x
    return e / e.sum(axis=-1, keepdims=True) if x.size else e


def _temperature(kept: list, weights: np.ndarray, idf: np.ndarray) -> float:
    """The temperature of least cross-entropy with smoothed targets on short cuts of the kept rows; 1 without any."""
    rng = np.random.Generator(np.random.PCG64(5))
    logits, truth = [], []
    for f, x, y in kept:
        share = x / idf[f]
        share = share / share.sum()
        for size in CUTS * CUT_TIMES:
            drawn = rng.multinomial(size, share)
            at = np.flatnonzero(drawn)
            logits.append((SCALE * drawn[at] / size * idf[f[at]]) @ weights[f[at]])
            truth.append(y)
    if not logits:
        return 1.0
    logits, truth = np.array(logits), np.array(truth)
    target = np.full(logits.shape, SMOOTHING / logits.shape[1])
    target[np.arange(len(truth)), truth] += 1 - SMOOTHING
    grid = np.exp(np.linspace(np.log(0.02), np.log(50), 200))
    loss = [-(target * np.log(_softmax(logits / t) + 1e-300)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _train(idf: np.ndarray, epochs: int):
    """One task: the bounded sample in, one pickled model out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "lang", "feature", "weight")))]
        rows.sort()
        languages = sorted({r[1] for r in rows}, key=lambda s: s.encode())
        if not languages:
            return
        weights = np.zeros((1 << BITS, len(languages)))
        z, n = np.zeros_like(weights), np.zeros_like(weights)
        data = []
        for _, lang, f, w in rows:
            f = np.frombuffer(f, np.int32)
            if len(f):
                data.append((f, SCALE * np.frombuffer(w, np.float32) * idf[f], languages.index(lang)))
        kept = data[::5]
        learn = [d for i, d in enumerate(data) if i % 5]
        for _ in range(epochs):
            for f, x, y in learn:
                p = _softmax(x @ weights[f])
                p[y] -= 1
                g = x[:, None] * p
                before = n[f]
                after = before + g * g
                zf = z[f] + g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * weights[f]
                z[f], n[f] = zf, after
                weights[f] = np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(after)) / ALPHA + L2))
        temperature = _temperature(kept, weights, idf)
        model = (languages, (weights * idf[:, None]).astype(np.float32), temperature)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model, protocol=5)], pa.binary())], names=["model"])

    return trimmed(run)


def fit(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> Model | None:
    """Learn from all rows of ``docs`` that have a language; None if there are none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    df = scratch.write(rows.select("text").mapInArrow(_document_frequencies, "feature long, n long").groupBy("feature").agg(
        F.sum("n").alias("n")), "frequencies").toPandas()  # at most 2 ** BITS + 1 rows
    count = np.zeros((1 << BITS) + 1)
    count[df["feature"].to_numpy(np.int64)] = df["n"].to_numpy(np.float64)
    if not count[-1]:
        return None
    idf = np.log((1 + count[-1]) / (1 + count[:-1])) + 1
    # a uniform share of each language, of the expected size ``per_language``; one row a language,
    # of which the dense model has a column each
    share = rows.groupBy("lang").agg(F.count("*").alias("n"))
    key = F.pmod(F.xxhash64(F.lit(7), F.col("id").cast("string")), F.lit(1 << 30))
    sample = rows.withColumn("key", key).join(F.broadcast(share), "lang").where(F.col("key") * F.col("n") < per_language * float(1 << 30))
    vectors = sample.select("lang", "key", "text").mapInArrow(_sample_vectors, "lang string, key long, feature binary, weight binary")
    found = vectors.repartition(1).mapInArrow(_train(idf, epochs), "model binary").collect()
    return Model(*pickle.loads(found[0]["model"])) if found else None


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, lettered = model.value.probabilities(b.column("text"))
            best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            names = np.array([*model.value.languages, UNKNOWN], object)
            lang = names[np.where(lettered, best, len(names) - 1)]
            score = np.where(lettered, p[np.arange(len(p)), best], 0.0)
            rest = [b.column(c) for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=[*(c for c in b.schema.names if c != "text"), "lang_pred", "score"])

    return trimmed(run)


def predict(docs: DataFrame, model: Model | None, carry: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The carried columns of every row, its language and the calibrated probability of it."""
    rows = docs.select(F.col(text_col).alias("text"), *(c.alias(n) for n, c in carry.items()))
    if model is None:
        return rows.drop("text").withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model)), f"{kinds}lang_pred string, score double")


def held_out(id_: Column) -> Column:
    """A fifth of all ids, from which nothing is learned."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 == 0
