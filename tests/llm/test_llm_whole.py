"""Rows and texts that operators once left out."""

import collections
import math

import numpy as np
import pytest

import corpus_pipeline
from fleetlens.llm import licences, queries, url_filter
from fleetlens.llm.fm_index import FMIndex
from fleetlens.llm.mixing import mix, numbered_rows, repeated
from fleetlens.llm.scratch import Scratch


def test_mixing_repeats_every_row_by_its_own_decision(spark):
    """Null ids, and one id over several texts and sources: row i has its words ``w<i>``."""
    rng = np.random.default_rng(11)
    rows = [(None if i % 3 else 7 if i % 2 else i, " ".join([f"w{i}"] * int(rng.integers(0, 30))), ["a", "b", "c", None][int(s)])
            for i, s in enumerate(rng.choice(4, 300, p=[0.1, 0.2, 0.6, 0.1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    numbered = numbered_rows(Scratch(spark, "t").write(df, "rows"))
    decided = mix(numbered, Scratch(spark, "t"))
    taken, targets = collections.Counter(), {}
    text = {r["_mix_row"]: r["text"] for r in numbered.collect()}
    for r in decided.collect():
        assert r["size"] == len(text[r["_mix_row"]].split())
        taken[text[r["_mix_row"]].split(" ")[0]] += r["taken"]
        targets[r["source"]] = r["target"]
    assert len(text) == len(rows)
    for out in (repeated(numbered, decided), corpus_pipeline.sources(spark, df, "")):
        assert out.columns == df.columns
        words, budget = collections.Counter(), collections.Counter()
        for r in out.collect():
            words.update(r["text"].split())
            budget[r["source"]] += len(r["text"].split())
        assert budget == {s: math.floor(t + 1e-9) for s, t in targets.items()}
    own = repeated(numbered, decided).collect()
    assert collections.Counter(w for r in own for w in r["text"].split()) == +taken
    with pytest.raises(Exception, match="share an id"):
        repeated(df, mix(df, Scratch(spark, "t"))).collect()


def test_links_are_read_as_html_has_them(spark):
    """Each odd page is an alias of a page that is blocked by way of its own canonical link."""
    link, refresh, block = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="{}">', "http://a.net/es/1"
    targets = ["http://q.org/p?page=2&ref=x", "http://q.org/a/x/y", "http://q.org/up/", "http://q.org/x;id=1", "http://q.org/y;id=1", "http://q.org/z?a=1&b=2",
               "http://q.org/c?a=1&copy=2", "http://q.org/o'b", "http://q.org/é?x"]
    odd = [("http://r.org/1", link.format("http://q.org/p?page=2&amp;ref=x")), ("http://r.org/2", link.format("http://q.org/p?page=2&#38;ref=x")),
           ("http://r.org/3", link.format("http://q.org/p?page=2&#x26;ref=x")), ("http://q.org/a/b/c", link.format("../x/./y")),
           ("http://r.org/4", link.format("http://q.org/a/b/%2E%2e/x/y")), ("http://q.org/up/b/c", link.format("..")),
           ("http://r.org/5", refresh.format("0; url=http://q.org/x;id=1")), ("http://r.org/6", refresh.format("0;URL='http://q.org/y;id=1' ")),
           ("http://r.org/7", refresh.format("0; url=http://q.org/z?a=1&amp;b=2")), ("http://r.org/8", link.format("http://q.org/c?a=1&copy=2")),
           ("http://r.org/9", link.format("http://q.org/o'b")), ("http://r.org/10", link.format(" http://q.org/&eacute;?x\n")),
           ("http://r.org/11", "<meta http-equiv=refresh content=0;url=http://q.org/x;id=1>"), ("http://q.org/up/d", link.format("../../../up/"))]
    free = [("http://s.org/1", link.format("http://q.org/x")), ("http://s.org/2", link.format("http://q.org/p?page=2")), ("http://q.org/a/b/x/y", "<p>")]
    pages = [(u, link.format(block)) for u in targets] + odd + free
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = url_filter.filter_urls(df, queries.URL_RULES, url_filter.html_links(df), Scratch(spark, "t")).collect()
    assert {pages[r["page_id"]][0] for r in got if r["verdict"] == "block"} == {u for u, _ in pages} - {u for u, _ in free} and len(got) == len(pages)


def test_licences_of_whole_texts_and_in_comments(spark):
    texts = {f.stem: f.read_text() for f in licences.TEXTS.glob("*.txt")}
    assert {"Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= texts.keys()
    rows = [(name, text) for name, text in texts.items()]
    rows += [(name, " ".join(licences.TEXTS.joinpath(f"{name}.txt").read_text().split("\n\n"))) for name in ("BSL-1.0", "Unlicense")]
    apache = texts["Apache-2.0"]
    rows += [("Apache-2.0", apache[:apache.index("APPENDIX")]), ("Apache-2.0", apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Jane Doe")),
             ("Apache-2.0", "\n\n".join(" ".join(p.split()) for p in apache.split("\n\n")))]
    bsd = texts["BSD-3-Clause"].replace("the University", "the copyright holder").replace("BY THE REGENTS", "BY THE COPYRIGHT HOLDERS").replace("THE REGENTS", "THE COPYRIGHT HOLDER")
    rows += [("BSD-3-Clause", "BSD 3-Clause License\n\n" + bsd), ("BSD-3-Clause", bsd.replace("1.", "*").replace("2.", "*").replace("3.", "*"))]
    body = licences.MIT.split("\n")
    for line in ("Copyright (c) 2020 X", "Copyright Jane Doe 2020", "Copyright Jane Doe 2018, 2020-2021. All rights reserved.", "(c) 2020 X", "(c) Jane Doe",
                 "© Jane Doe", "Copyright © 2020", "Copyright: 2020 X", "All rights reserved."):
        rows += [("MIT", "\n".join([sign + x for x in [line, "", *body]])) for sign in ("", "# ", " * ", "// ", "-- ", ";; ", "<!-- ", "' ")]
    rows += [(None, line + "\n" + licences.MIT) for line in ("Copyright law was made in 1709 and has changed since", "Some prose (c) 2020", "The words copyright 2020")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan(df).collect()}
    assert [(i, got[i], t[:60]) for i, (name, t) in enumerate(rows) if got[i] != name] == []


def test_intervals_of_the_backward_search_hold_the_equal_windows():
    rng = np.random.default_rng(3)
    for threshold in (1, 3, 5):
        parts = [rng.integers(1, 4, int(rng.integers(0, 40))) for _ in range(30)] + [np.ones(20, np.int64)] * 2
        owner = rng.permutation(len(parts))
        windows = {(p, i): tuple(x[i:i + threshold].tolist()) for p, x in enumerate(parts) for i in range(len(x) - threshold + 1)}
        count, least = collections.Counter(windows.values()), {}
        for (p, _), w in windows.items():
            least[w] = min(least.get(w, len(parts)), int(owner[p]))
        index = FMIndex(np.concatenate(parts), np.array([len(x) for x in parts]), owner, threshold)
        passage, at, low, past = index.matches()
        assert {(p, i): n for p, i, n in zip(passage.tolist(), at.tolist(), (past[low] - low).tolist())} == {k: count[w] for k, w in windows.items()}
        assert {(p, i): n for p, i, n in zip(*(x.tolist() for x in index.search()))} == {k: least[w] for k, w in windows.items()}


def test_licence_lines_are_judged_by_their_own_row(spark):
    """Rows that share an id, or have none, and differ only in punctuation or line breaks; breaks inside lines."""
    mit = "Released under the MIT License."
    rows = [(1, f"{mit} foo"), (1, f"{mit}\nfoo"), (None, f"{mit} foo"), (None, f"{mit}\n foo"), (2, f"{mit}\n{mit}"), (2, f"{mit}\n{mit}"), (3, None), (None, None),
            (4, f"  ** RELEASED -- under the mit LICENCE!\r\nother"), (5, f"Copyright (c) 2020 X\r{mit}\nother"), (6, f"Copyright (c) 2020 X\n{mit}"), (7, "re"), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r["doc_id"], r["line_licences"], r["n_licence_lines"], r["licence"]) for r in licences.scan(df).collect()), key=str)
    want = [(1, "", 0, None), (1, "MIT", 1, None), (None, "", 0, None), (None, "MIT", 1, None), (2, "MIT", 2, None), (2, "MIT", 2, None), (3, "", 0, None),
            (None, "", 0, None), (4, "MIT", 1, None), (5, "MIT", 1, None), (6, "MIT", 1, "MIT"), (7, "", 0, None), (8, "", 0, None)]
    assert got == sorted(want, key=str)


def test_every_known_text_passes_the_gate_of_its_first_letters(spark):
    """Whatever spelling, case or signs a known text begins with, one line of it is still looked up."""
    known = [("A", "text", "Licence of one"), ("B", "text", "non-infringement is two"), ("C", "text", "Éa three"), ("D", "text", "4 ever"), ("E", "text", "a b")]
    rows = [(1, "## LICENSE of (one)"), (2, "Noninfringement is two"), (3, "Éa   three!"), (4, "-- 4 EVER"), (5, "A, B"), (6, "licens of one")]
    got = {r["doc_id"]: r["line_licences"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), known=known).collect()}
    assert got == {1: "A", 2: "B", 3: "C", 4: "D", 5: "E", 6: ""}
