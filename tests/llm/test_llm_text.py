"""Quality, licences, urls, mixing, language, tokenising and packing against brute force."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetlens.llm import langid, licences, oracle, quality, queries, tokenise, url_filter, words
from fleetlens.llm.mixing import mix, repeated
from fleetlens.llm.packing import _Places, pack, plan
from fleetlens.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", " \n\t", "a", "a\n\na\n a\nb", "#$ # *x*", "the the the the the the", "one two three one two three\nLine\nLine", "é ü! É\x0bz", "w " * 30_000]


def docs(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("id", F.lit(1)).withColumn("n_words", F.lit("clash")).withColumn("size", F.lit(2)).withColumn("key", F.lit(3))


@given(st.lists(st.none() | st.text("aB é\t\n\x0b\x1c\x85z,", max_size=12), max_size=8), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_words_and_grams(texts, k):
    got, seen = [], {}
    for w in words.chunks(pa.array(texts, pa.string()), limit=10):
        h, off = words.grams(w, k, short=True)
        for d in range(len(w.offset) - 1):
            own = [w.data[s:e].tobytes().decode() for s, e in zip(w.start[w.offset[d]:w.offset[d + 1]], w.end[w.offset[d]:w.offset[d + 1]])]
            got.append(own)
            want = [tuple(own[i:i + k]) for i in range(len(own) - k + 1)] or ([tuple(own)] if own else [])
            assert len(want) == off[d + 1] - off[d]
            for x, y in zip(want, h[off[d]:off[d + 1]].tolist()):
                assert seen.setdefault(x, y) == y
    assert got == [WORD.findall(t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)


def base_features(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_features_and_verdicts(spark):
    prose = ["the quick brown fox jumps over lazy dogs while it rains number " + " ".join(f"word{i * j}" for i in range(60)) for j in range(1, 40)]
    junk = [" | ".join(f"word{i * j}" for i in range(60)) for j in range(1, 8)] + [" ".join(f"LOUD{i * j}!!" for i in range(60)) for j in range(1, 8)]
    rows = list(enumerate(EDGES + prose + junk)) + [(None, "a b c"), (3, "a")]
    got = quality.score(docs(spark, rows), Scratch(spark, "t")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=str) == sorted(((i, *base_features(t)) for i, t in rows), key=str)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept == set(range(len(EDGES), len(EDGES) + len(prose)))
    assert quality.score(docs(spark, []), Scratch(spark, "t")).count() == 0


def test_quality_posteriors_follow_em(spark):
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.7
    votes = [[None if rng.random() < 0.3 else int(t == (rng.random() < a)) for a in (0.9, 0.8, 0.75)] for t in truth]
    count = collections.Counter(map(tuple, votes))
    frame = spark.createDataFrame([(list(v), n) for v, n in count.items()], "votes array<tinyint>, n long")
    got = {tuple(r["votes"]): r["posterior"] for r in quality.posteriors(frame, 3).collect()}
    q = {v: quality.SOME_BAD if 0 in v else quality.NO_BAD for v in count}
    for _ in range(quality.ITERATIONS):
        mass = {g: sum(n * (q[v] if g else 1 - q[v]) for v, n in count.items()) for g in (0, 1)}
        rate = {(g, r, x): (sum(n * (q[v] if g else 1 - q[v]) for v, n in count.items() if v[r] == x) + quality.SMOOTH) / (mass[g] + 3 * quality.SMOOTH)
                for g in (0, 1) for r in range(3) for x in (0, 1, None)}
        prior = (mass[1] + quality.SMOOTH) / (mass[0] + mass[1] + 2 * quality.SMOOTH)
        q = {v: 1 / (1 + (1 - prior) / prior * math.prod(rate[0, r, v[r]] / rate[1, r, v[r]] for r in range(3))) for v in count}
    assert got.keys() == q.keys() and all(abs(got[v] - q[v]) < 1e-9 for v in q)


def test_licences(spark):
    british = licences.MIT.replace("sublicense", "sublicence").upper().replace("\n", "  \n\t")
    rows = [(1, "Copyright (c) 2020 Jane Doe\n" + licences.MIT), (2, british), (3, "Some prose.\nReleased under the MIT Licence!\nMore."),
            (4, None), (5, ""), (6, "x\n\nLicensed under CC BY-NC 4.0.\nlicensed under cc-by-nc 4.0"), (7, licences.MIT + " and more"),
            (3, "Some prose.\nReleased under the MIT Licence!\nMore."), (None, "Licensed under CC BY 4.0")]
    got = sorted(((r["doc_id"], r["licence"], r["line_licences"], r["n_licence_lines"]) for r in licences.scan(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "MIT", "", 0), (2, "MIT", "", 0), (3, None, "MIT", 1), (3, None, "MIT", 1), (4, None, "", 0), (5, None, "", 0),
                          (6, None, "CC-BY-NC-4.0", 2), (7, None, "", 0), (None, "CC-BY-4.0", "CC-BY-4.0", 1)], key=str)
    assert licences.scan(docs(spark, [])).count() == 0


RULES = queries.URL_RULES


def test_urls_and_aliases(spark):
    link = '<html><head><link href="{}" rel="canonical"></head>'
    pages = [(1, "http://A.net/es/1?q#f", "<p>"), (2, "https://b.org/x", link.format("http://a.net/es/1?q")), (3, "http://c.org/y", link.format("//b.org/x")),
             (4, "http://www.example.com/en/z", link.format("http://example.com/en/z")), (5, "http://d.org", link.format("http://www.example.com/en/z")),
             (6, None, None), (7, "nothing", ""), (8, "http://e.org/a/b", '<META http-equiv=refresh content="0; URL=c">'), (9, "http://e.org/a/c", None),
             (10, "http://xexample.com/en/", None), (11, "http://net/fr/", None), (12, "http://f.net/fr", None), (2, "https://b.org/x", None),
             (13, "http://g.org/", link.format("/")), (14, "http://example.com", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("node", F.lit(2))
    got = url_filter.filter_urls(df, RULES, url_filter.html_links(df), Scratch(spark, "t"))
    rows = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert got.count() == len(pages) and rows == {
        (1, "a.net", "/es/1", "net/es/", "block"), (2, "b.org", "/x", None, "block"), (3, "c.org", "/y", None, "block"),
        (4, "www.example.com", "/en/z", "www.example.com/en/", "allow"), (5, "d.org", "", None, "allow"), (6, "", "", None, "allow"),
        (7, "", "", None, "allow"), (8, "e.org", "/a/b", None, "allow"), (9, "e.org", "/a/c", None, "allow"),
        (10, "xexample.com", "/en/", "com/", "allow"), (11, "net", "/fr/", "net/fr/", "block"), (12, "f.net", "/fr", None, "allow"),
        (13, "g.org", "/", None, "allow"), (14, "example.com", "", None, "allow")}
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [p[0] for p in pages], "url": [p[1] for p in pages], "html": [p[2] for p in pages]}))
    assert {tuple(r) for r in con.sql(f"select page_id, host, path, rule, verdict from ({oracle.URLS})").fetchall()} == rows
    empty = df.limit(0)
    assert url_filter.filter_urls(empty, RULES, url_filter.html_links(empty), Scratch(spark, "t")).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        room = total - sum(capped.values())
        target = {s: room * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    rng = np.random.default_rng(5)
    source = [None, "a", "b", "é", "big", "nothing"]
    rows = [(int(i), "x " * int(rng.integers(0, 30)), source[int(s)]) for i, s in enumerate(rng.choice(5, 400, p=[0.05, 0.05, 0.1, 0.1, 0.7]))]
    rows += [(1000, None, "nothing"), (1001, "", "nothing"), (None, "a b c", "a"), (7, "y y", "b"), (7, "y y", "b")]
    df = docs(spark, rows, "doc_id long, text string, source string")
    got = mix(df, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = brute_targets(sizes), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7), Scratch(spark, "t")).collect()))
    assert mix(df.limit(0), Scratch(spark, "t")).count() == 0
    unique = docs(spark, [r for r in rows if r[0] is not None and r[0] != 7], "doc_id long, text string, source string")
    decided = mix(unique, Scratch(spark, "t"))
    out = repeated(unique, decided)
    assert out.columns == unique.columns
    words_out = collections.Counter()
    for r in out.collect():
        words_out[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    assert words_out == collections.Counter({r["doc_id"]: r["taken"] for r in decided.collect() if r["taken"]})


def test_langid(spark):
    con = duckdb.connect()
    rows = con.sql("select doc_id, text, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    odd = [(5000, None, "en"), (5001, "", "de"), (5002, "123 !!", "fr"), (None, "the and of", None), (5003, "the and of", None), (5003, "the and of", None),
           (5004, "des " * 40_000, None)]
    df = docs(spark, rows + odd, "doc_id long, text string, lang string")
    learn = df.where(~langid.held_out(F.col("doc_id")))
    model = langid.fit(learn, Scratch(spark, "t"), per_language=150, epochs=1)
    out = langid.predict(df, model, {"doc_id": F.col("doc_id"), "lang": F.col("lang")}).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (5000, 5001, 5002))
    assert by[5003]["lang_pred"] in model.languages and 0 < by[5003]["score"] <= 1
    fresh = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 5000 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["lang"] == r["lang_pred"] for r in fresh]) > 0.97
    blind = df.withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit(blind, Scratch(spark, "t")) is None
    assert {r["lang_pred"] for r in langid.predict(blind, None, {"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert langid.predict(df.limit(0), model, {"doc_id": F.col("doc_id")}).count() == 0


@pytest.fixture(scope="module")
def path():
    return str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


HARD = ["", None, "a", "Hello, World!! it's don't 'sup can'T the.", "x<|endoftext|>y <|STARTOFTEXT|>", "J̌ é É, ≠ ,́ a,́", "École ÉÀ×÷ß, ẞtraße İstanbul Σας",
        "  x  y", "日本語。テスト, ok", "a\x00b \x1c c\x85d", "123 4,5! 'll 're'd", "½²³ ①", "…a… a… a,… é,… é.", "<| |> <", "\U0001F600!!", " \n\t "]


@given(st.lists(st.text(st.sampled_from("aZé'É,.!<|>s t\ńß×1…J̌") | st.characters(codec="utf-8"), max_size=25), max_size=5))
@settings(max_examples=150, deadline=None)
def test_tokeniser_matches_the_library(path, texts):
    t = tokenise.tokenizer(path)
    got = [ids[a:b].tolist() for _, ids, off in t.encode(pa.array(HARD + texts, pa.string())) for a, b in zip(off[:-1], off[1:])]
    assert got == [t.plain.encode(x or "", add_special_tokens=False).ids for x in HARD + texts]


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
@settings(max_examples=150, deadline=None)
def test_plan_uses_every_piece_once(counts):
    patterns = plan(counts, 40)
    used = collections.Counter()
    for p in patterns:
        assert p.times > 0 and sum(p.lengths) <= 40
        for x in p.lengths:
            used[x] += p.times
    assert used == collections.Counter(counts)
    places = _Places(patterns)
    filled = collections.defaultdict(list)
    for x, n in counts.items():
        sequence, offset = places.at(np.full(n, x), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            filled[s].append((o, x))
    assert len(filled) == sum(p.times for p in patterns)
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [x for _, x in parts])[:-1])
    assert len(filled) <= max(1, 2 * math.ceil(sum(x * n for x, n in counts.items()) / 40))


def test_packing(spark, path):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(3, HARD[3]), (None, "null id")] + [(100 + i, f"some words {i} " * (i + 1)) for i in range(150)]
    packed = pack(docs(spark, rows).repartition(3), Scratch(spark, "t"), path, capacity=64).joined().collect()
    t = tokenise.tokenizer(path)
    want = []
    for i, text in rows:
        ids = t.plain.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(i, k // 64, k, ids[k:k + 64]) for k in range(0, len(ids), 64)]
    got = [(r["id"], r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in packed]
    assert sorted(got, key=str) == sorted(want, key=str)
    filled = collections.defaultdict(list)
    for r in packed:
        assert 4 * r["length"] == len(r["ids"])
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [x for _, x in parts])[:-1]) and sum(x for _, x in parts) <= 64
    assert pack(docs(spark, []), Scratch(spark, "t"), path).joined().count() == 0
