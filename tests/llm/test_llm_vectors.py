"""Vector codes, fill-in-the-middle and passage quality against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import fill_middle, passage_quality, vector_codes
from fleetlens.llm.langid import held_out

INF = float("inf")


# vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Codes, errors and codebooks of (id, vector) rows by plain whole-number arithmetic."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))]
    d = len(kept[0][1]) // parts
    cut = [(i, [v[p * d:(p + 1) * d] for p in range(parts)]) for i, v in kept]
    books = [[v[p] for _, v in cut[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for _, v in cut:
                members.setdefault(nearest(book, v[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e for k, e in enumerate(book)]
    found = [(i, *zip(*(nearest(books[p], v[p]) for p in range(parts)))) for i, v in cut]
    return [(i, "".join(f"{k:02x}" for k in ks), sum(es)) for i, es, ks in found], books


@pytest.mark.parametrize("n,width,spread", [(300, 64, 0.2), (40, 16, 3.0), (200, 32, 0.01), (150, 16, 400.0)])
def test_codes_equal_brute_force(spark, n, width, spread):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, spread) for _ in range(width)]) for i in range(n)]
    rows += [(i + n, rows[i % 7][1]) for i in range(n // 3)]  # copies in one hot group
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    codes = vector_codes.encode(frame, {"vec_id": F.col("vec_id")})
    want, books = plain_codes(rows)
    assert sorted(map(tuple, codes.rows.collect())) == sorted(want)
    assert codes.codebooks.tolist() == books
    flat = ",".join(str(x) for b in books for e in b for x in e)
    assert codes.sha256 == hashlib.sha256(flat.encode()).hexdigest()


def test_boxes_hold_the_entries_within_the_radius():
    rng = np.random.default_rng(5)
    entries = rng.integers(-20, 20, (64, 4))
    book, x, radius = vector_codes.Slices(entries), rng.integers(-25, 25, (500, 4)), rng.integers(0, 12, 500)
    want = (np.abs(x[:, None] - entries[None]) <= radius[:, None, None]).all(axis=2)
    masks = book.box(x, radius)
    assert [[bool(int(m) >> e & 1) for e in range(64)] for m in masks] == want.tolist()
    code, error = book.nearest(x)
    gaps = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert code.tolist() == gaps.argmin(axis=1).tolist() and error.tolist() == gaps.min(axis=1).tolist()


def test_vectors_that_are_dropped_and_odd_ids(spark):
    good = [0.25] * 16
    rows = [(None, good, "a"), (3, None, "a"), (4, good[:-1] + [None], None), (5, good[:-1] + [float("nan")], "b"), (6, [INF] + good[1:], "b"),
            (7, [-INF] + good[1:], "b"), (8, [0.5] * 16, None), (8, [-0.001] * 16, None), (9, [1.0] * 32, "a"), (10, [], "a"), (11, [1.0] * 17, "a"),
            (12, [1e30] * 16, "b"), (12, [1e30] * 16, "b")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").withColumn("code", F.lit("clash")).withColumn("error", F.lit(1))
    codes = vector_codes.encode(frame, {"vec_id": F.col("vec_id"), "label": F.col("label"), "was": F.col("code")})
    got = sorted(vector_codes.label_errors(codes.rows).select("vec_id", "label", "code", "error", "label_error", "was").collect(), key=str)
    assert sorted(r["vec_id"] or -1 for r in got) == [-1, 8, 8, 12, 12] and all(r["error"] == 0 and r["label_error"] == 0 and r["was"] == "clash" for r in got)
    assert codes.codebooks[0, :, 0].tolist() == [-1, 128, 1 << 26, 1 << 26, 64]  # floors go down; equal ids by components; no id last
    assert len({r["code"] for r in got if r["vec_id"] == 12}) == 1


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    for rows in (frame, frame.where("false")):
        codes = vector_codes.encode(rows, {"vec_id": F.col("vec_id"), "label": F.col("label")})
        assert vector_codes.label_errors(codes.rows).collect() == [] and codes.rows.columns == ["vec_id", "label", "code", "error"]
        assert codes.sha256 == hashlib.sha256(b"").hexdigest()


def test_label_errors_keep_nulls_together(spark):
    rows = spark.createDataFrame([(1, None, 3), (2, None, 4), (3, 1, 5), (4, 1, 6), (5, 2, 2 ** 62), (6, 2, 2 ** 62)], "vec_id long, label int, error long")
    assert {r["vec_id"]: r["label_error"] for r in vector_codes.label_errors(rows).collect()} == {1: 7, 2: 7, 3: 11, 4: 11, 5: None, 6: None}


# fill in the middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ALPHABET = ["a", "B", "zz", " ", "\n", "é", "中", "😀", "<", ">", "<P", "S>", "P", "M>", "1", "\u0000", "-"]


def fim_rows():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(ALPHABET, k=rng.choice([0, 1, 2, 5, 40, 300])))) for i in range(400)]
    rows += [(5, "again"), (5, "again"), (5, "other"), (None, "no id"), (None, None), (700, None), (701, ""), (702, "<P>x"), (703, "x<M>"),
             (704, "a<"), (705, "ab"), (706, "word " * 120_000), (707, "中" * 200_000), (708, "x" * 600_000)]
    return rows


@pytest.mark.parametrize("block,slice_", [(1 << 18, 1 << 25), (7, 64)])
def test_outputs_and_round_trip_of_bytes(monkeypatch, block, slice_):
    monkeypatch.setattr(fill_middle, "_BLOCK", block)
    monkeypatch.setattr(fill_middle, "_SLICE", slice_)
    rows = [r for r in fim_rows() if len(r[1] or "") < 1000]
    want = [plain_fim(*r) for r in rows]
    h = np.array([[int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for k in range(4)] for i, _ in rows])
    seen = 0
    for part, data, off in fill_middle._slices(pa.array([t for _, t in rows], pa.string())):
        n, form, prefix, middle, out, out_off = fill_middle.scattered(data, off, h[part])
        texts = [out[a:b].tobytes().decode() for a, b in zip(out_off[:-1], out_off[1:])]
        for k, w in enumerate(want[part]):
            assert (n[k], fill_middle.FORMS[form[k]], texts[k]) == (w[0], w[1], w[4])
            assert w[1] == "plain" or (prefix[k], middle[k]) == w[2:4]
        back, back_off, good = fill_middle.gathered(out, out_off, form)
        assert good.all() and [back[a:b].tobytes().decode() for a, b in zip(back_off[:-1], back_off[1:])] == [t or "" for _, t in rows[part]]
        seen += len(n)
    assert seen == len(rows)


def test_outputs_equal_brute_force(spark):
    rows = fim_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit("clash"))
    cut = fill_middle.transform(docs.repartition(3), {"doc_id": F.col("doc_id"), "n_given": F.col("n")})
    got = sorted(map(tuple, cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=str)
    assert got == sorted(((i, *plain_fim(i, t)) for i, t in rows), key=str)
    back = fill_middle.restore(cut, {"doc_id": F.col("doc_id")}).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_malformed_outputs_are_not_restored(spark):
    rows = [("<P>a<S>b<M>c", "psm", "acb"), ("<S>b<P>a<M>c", "spm", "acb"), ("<S>b<P>a<M>c", "psm", None), ("<P>a<S>b", "psm", None), ("x<P>a<S>b<M>c", "psm", None),
            ("<P>a<S>b<M>c<M>", "psm", None), ("plain", "plain", "plain"), (None, "plain", None), ("x", "what", None), ("x", None, None), ("", "psm", None),
            ("<P><S><M>", "psm", ""), ("<P>a<S>b<M>c", "plain", "<P>a<S>b<M>c")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, output string, form string, want string")
    assert [(r["want"], r["restored"]) for r in fill_middle.restore(frame, {"want": F.col("want")}).collect()] == [(w, w) for *_, w in rows]


def test_no_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.restore(fill_middle.transform(docs, {"doc_id": F.col("doc_id")}), {"doc_id": F.col("doc_id")}).collect() == []


# passage quality


def plain_features(text):
    """Feature rows of a text's passages, with the words' hashes taken from the library."""
    from fleetlens.llm.words import chunks

    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    hashed = {w: int(next(iter(chunks(pa.array([w.decode()])))).hash[0]) for w in set(words)}
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]

    def kind(b):
        return (1 if 97 <= b < 123 else 2 if 65 <= b < 91 else 3 if 48 <= b < 58 else 4 + signs.index(b) if b in signs
                else 37 if b >= 0xC0 else 38 if b >= 0x80 else 36)

    pairs = set()
    again = []
    for k in range(len(words)):
        pair = tuple(words[k:k + 2])
        again.append(len(pair) == 2 and pair in pairs)
        pairs.add(pair)
    out = []
    for at in range(0, max(1, len(words)), passage_quality.PASSAGE):
        part = words[at:at + passage_quality.PASSAGE]
        n, size = max(1, len(part)), sum(map(len, part))
        x = [0.0] * passage_quality.FEATURES
        for w in part:
            for b in w:
                x[kind(b) - 1] += 1 / size
            h = hashed[w]
            x[43 + h % passage_quality.HASHED] += (1 if h >> 63 else -1) / math.sqrt(n)
        x[:38] = [math.sqrt(v) for v in x[:38]]
        x[38:43] = [math.log1p(size / n), len(set(part)) / n, sum(a == b for a, b in zip(part, part[1:])) / n,
                    sum(again[at:at + len(part)]) / n, len(part) / passage_quality.PASSAGE]
        out.append(x)
    return np.array(out)


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    f, h, g = passage_quality.FEATURES, 6, 4
    return passage_quality.Model(rng.normal(size=f), 1 + rng.random(f), rng.normal(size=(f, h)) / 8, rng.normal(size=h), rng.normal(size=(h, g)),
                                 rng.normal(size=(h, g)), rng.normal(size=g), rng.normal(size=h), rng.normal(size=1))


def plain_score(m, x):
    hs = [np.tanh((row - m.mean) / m.scale @ m.E + m.e) for row in x]
    gates = [float((np.tanh(h @ m.V) / (1 + np.exp(-(h @ m.U)))) @ m.w) for h in hs]
    total = sum(map(math.exp, gates))
    weights = [math.exp(g) / total for g in gates]
    return 1 / (1 + math.exp(-float(sum(a * h for a, h in zip(weights, hs)) @ m.c + m.c0[0]))), weights


TEXTS = [None, "", " \n\t", "one", "One two two three!", "x " * 63, "x " * 64, "y z " * 64 + "end", "é中😀 \x7f <b> a_b 12,5 %", "ab cd ef " * 3000,
         "z" * 300_000, "lead " + "\n" * 5000 + " trail"]


def test_scores_equal_plain_forward_pass(spark, monkeypatch):
    m = small_model()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(2, "same id"), (None, "no id")], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("clash"))
    monkeypatch.setattr(passage_quality, "_BLOCK", 50)
    for parts in (1, 4):
        rows = passage_quality.score(docs.repartition(parts), m, {"doc_id": F.col("doc_id"), "body": F.col("text")}).collect()
        assert len(rows) == len(TEXTS) + 2
        for r in rows:
            want, weights = plain_score(m, plain_features(r["body"]))
            assert abs(r["score"] - want) < 1e-5 and r["n_passages"] == len(weights)
            assert abs(r["top_weight"] - max(weights)) < 1e-5 and abs(weights[r["top_passage"]] - max(weights)) < 1e-5


def test_gradients_equal_differences():
    m = small_model(2)._replace(mean=np.zeros(passage_quality.FEATURES), scale=np.ones(passage_quality.FEATURES))
    rng = np.random.default_rng(3)
    offset, y = np.array([0, 1, 4, 9]), np.array([1.0, 0.0, 0.5])
    x = rng.normal(size=(9, passage_quality.FEATURES))
    _, grad = passage_quality.gradients(m, x, offset, y)
    for name, g in grad.items():
        v = getattr(m, name)
        for at in [tuple(rng.integers(0, s) for s in v.shape) for _ in range(5)]:
            moved = []
            for step in (1e-5, -1e-5):
                w = v.copy()
                w[at] += step
                moved.append(passage_quality.gradients(m._replace(**{name: w}), x, offset, y)[0])
            assert abs((moved[0] - moved[1]) / 2e-5 - g[at]) < 1e-6


def test_one_bad_passage_among_many_decides():
    """Bags differ in one passage only, which attention has to find."""
    rng = np.random.default_rng(7)
    size, bags = 8, 600
    x = rng.normal(0, 0.3, (size * bags, passage_quality.FEATURES)).astype(np.float32)
    y = (np.arange(bags) % 2).astype(float)
    where = rng.integers(0, size, bags)
    x[np.arange(bags)[y == 0] * size + where[y == 0], :4] += 4
    offset = np.arange(bags + 1) * size
    learn = np.arange(bags) < 400
    m = passage_quality.train(x[:400 * size], offset[:401], y[:400])
    score, weight = m.pool(m.encode(x), offset)
    assert ((score > 0.5) == y)[~learn].mean() > 0.95
    top = weight.reshape(bags, size).argmax(axis=1)
    assert (top == where)[~learn & (y == 0)].mean() > 0.9


def test_fit_reads_labels_only_where_it_may(spark):
    words = "alpha beta gamma delta river stone over under light".split()
    rng = random.Random(4)
    good = [(i, " ".join(rng.choices(words, k=rng.randint(1, 300)))) for i in range(120)]
    bad = [(i + 1000, " ".join(w + rng.choice("#$%&*") * 3 for w in rng.choices(words, k=rng.randint(1, 300)))) for i in range(120)]
    docs = spark.createDataFrame(good + bad + [(1, "same id"), (None, "no id"), (5000, None)], "doc_id long, text string").withColumn("quality", F.lit(7))
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad] + [(1, 1), (2, None), (3, 9), (None, 0), (777777, 0)], "doc_id long, quality int")
    model = passage_quality.fit(docs, labels)
    again = passage_quality.fit(docs.repartition(7), labels.repartition(3))
    assert all(np.allclose(a, b) for a, b in zip(model, again))
    rows = passage_quality.score(docs, model, {"doc_id": F.col("doc_id")}).where("doc_id is not null and doc_id < 2000").collect()
    right = [(r["score"] >= 0.3) == (r["doc_id"] < 1000) for r in rows]
    assert sum(right) / len(right) > 0.97
    assert passage_quality.fit(docs, labels.where("false")) is None and passage_quality.fit(docs.where("false"), labels) is None
    none = passage_quality.score(docs, None, {"doc_id": F.col("doc_id")})
    assert {r["score"] for r in none.collect()} == {0.5} and none.count() == 243
    assert passage_quality.score(docs.where("false"), model, {"doc_id": F.col("doc_id")}).collect() == []


def test_a_hot_id_gives_no_more_rows_than_the_bound(spark):
    rows = [(1, f"copy {i % 50} of one id") for i in range(400)] + [(i, f"### {i}") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 40)], "doc_id long, quality int")
    model = passage_quality.fit(docs, labels, per_label=20)
    got = passage_quality.score(docs, model, {"doc_id": F.col("doc_id")}).collect()
    assert len(got) == len(rows) and sum((r["score"] >= 0.3) == (r["doc_id"] == 1) for r in got) > 0.95 * len(got)


def test_held_out_quality(spark):
    """The registered query on given tables: held-out documents are judged as their labels are."""
    from fleetlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    pytest.importorskip("os").path.isdir(sf) or pytest.skip("driver tables not present")
    rows = QUERIES["op11_passage_quality"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows.count() == docs.count() == rows.select("doc_id").distinct().count()
    got = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got["predicted"] == got["quality"]).mean() > 0.95
    assert rows.where(F.col("held_out") != held_out(F.col("doc_id"))).count() == 0
    assert ((got["score"] - got["quality"]) ** 2).mean() < 0.05
    assert rows.where("not (score between 0 and 1) or predicted != cast(score >= 0.3 as int)").count() == 0


def test_given_embeddings_equal_brute_force(spark):
    from fleetlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    pytest.importorskip("os").path.isdir(sf) or pytest.skip("driver tables not present")
    table = pd.read_parquet(f"{sf}/embeddings.parquet")
    want, _ = plain_codes([(int(i), [float(x) for x in v]) for i, v in zip(table["vec_id"], table["embedding"])])
    got = QUERIES["op12_vector_codes"](spark, sf).select("vec_id", "code", "error").collect()
    assert sorted(map(tuple, got)) == sorted(want)
