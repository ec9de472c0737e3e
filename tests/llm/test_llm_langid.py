"""Training and calibration of the language classifier."""

import math
import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import langid
from fleetlens.llm.scratch import Scratch


def plain_training(data, languages, epochs):
    """Follow-the-regularised-leader on (features, values, language) rows, one number at a time."""
    z, n, w = {}, {}, {}
    for _ in range(epochs):
        for features, values, y in data:
            logits = [sum(x * w.get((f, c), 0.0) for f, x in zip(features, values)) for c in range(languages)]
            top = max(logits)
            e = [math.exp(v - top) for v in logits]
            p = [v / sum(e) for v in e]
            for f, x in zip(features, values):
                for c in range(languages):
                    g = x * (p[c] - (c == y))
                    before = n.get((f, c), 0.0)
                    n[f, c] = before + g * g
                    z[f, c] = z.get((f, c), 0.0) + g - (math.sqrt(n[f, c]) - math.sqrt(before)) / langid.ALPHA * w.get((f, c), 0.0)
            for f in features:
                for c in range(languages):
                    v = z[f, c]
                    rate = (langid.BETA + math.sqrt(n[f, c])) / langid.ALPHA + langid.L2
                    w[f, c] = 0.0 if abs(v) <= langid.L1 else -(v - math.copysign(langid.L1, v)) / rate
    return w


@pytest.mark.parametrize("rows", [1, 4, 60])
def test_trainer_equals_plain_python(rows):
    rng = np.random.default_rng(rows)
    idf = 1 + rng.random(1 << langid.BITS)
    lang = [["de", "en", "fr"][k % 3] for k in range(rows)]
    feature = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(rows)]
    weight = [rng.dirichlet(np.ones(len(f))).astype(np.float32) for f in feature]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(rows), pa.int64()), pa.array(lang), pa.array([f.tobytes() for f in feature], pa.binary()),
         pa.array([w.tobytes() for w in weight], pa.binary())], names=["key", "lang", "feature", "weight"])
    found = next(iter(langid._train(idf, 2)(iter([batch]))))
    languages, weights, temperature = pickle.loads(found.column("model")[0].as_py())
    names = sorted(set(lang))
    data = [(f.tolist(), (langid.SCALE * w * idf[f]).tolist(), names.index(s)) for f, w, s in zip(feature, weight, lang)]
    want = plain_training([d for i, d in enumerate(data) if i % 5], len(names), 2)  # every fifth row calibrates
    assert languages == names and 0.02 <= temperature <= 50
    dense = np.zeros_like(weights)
    for (f, c), v in want.items():
        dense[f, c] = v * idf[f]
    assert np.allclose(weights, dense, atol=1e-4)


def test_calibration_on_short_cuts(spark):
    """Scores of 20-character cuts of held-out texts mean what they say; other languages are in doubt."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~out), Scratch(spark, "t"))
    assert 0.05 < model.temperature < 20
    used = model.weights.any(axis=1)
    assert used.any() and (model.weights[used] == 0).mean() > 0.01  # some weights are cut to 0
    rng = np.random.default_rng(1)
    cuts, lang = [], []
    for r in docs.where(out).collect():
        for _ in range(3 if r["text"] and len(r["text"]) > 40 else 0):
            k = rng.integers(0, len(r["text"]) - 20)
            cuts.append(r["text"][k:k + 20]), lang.append(r["lang"])
    p, _ = model.probabilities(pa.array(cuts))
    score, right = p.max(axis=1), np.array(model.languages)[p.argmax(axis=1)] == np.array(lang)
    error = 0.0
    for low in np.arange(0, 1, 0.2):
        inside = (score > low) & (score <= low + 0.2)
        if inside.any():
            error += inside.mean() * abs(score[inside].mean() - right[inside].mean())
    assert right.mean() > 0.9 and error < 0.08
    other = "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita".split()
    p, _ = model.probabilities(pa.array([" ".join(rng.choice(other, 60)) for _ in range(50)]))
    assert np.median(p.max(axis=1)) < 0.7


def test_predictions_without_carried_columns(spark):
    docs = spark.createDataFrame([(i, "the and of" if i % 2 else "der und die", "en" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.fit(docs, Scratch(spark, "t"))
    out = langid.predict(docs, model, {})
    assert out.columns == ["lang_pred", "score"] and {r["lang_pred"] for r in out.collect()} == {"de", "en"}
