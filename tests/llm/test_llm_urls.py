"""Links of html pages: what counts as one, and which urls are the same."""

import re

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import queries, url_filter
from fleetlens.llm.scratch import Scratch

PAGES = [
    ('<link data-href="http://no/" rel="canonical" href="http://yes/">', "http://yes/", "", ""),
    ('<link rel="alternate canonical" href="/a">', "/a", "", ""),
    ('<LINK REL=Canonical HREF=/a>', "/a", "", ""),
    ('<link rel="canonicals" href="/a"><link rel="alternate" href="/b">', "", "", ""),
    ('<link title="a > b" rel=\'canonical\' href="/a?x=1&amp;y=2">', "/a?x=1&y=2", "", ""),
    ('<link rel="canonical"><link rel="canonical" href=""><link rel="canonical" href="/real"><link rel="canonical" href="/second">', "/real", "", ""),
    ('<!-- <link rel="canonical" href="/no"> --><link rel="canonical" href="/yes">', "/yes", "", ""),
    ('<!--><link rel="canonical" href="/yes">', "/yes", "", ""),
    ('<!-- open <link rel="canonical" href="/no">', "", "", ""),
    ('<script>var s = \'<link rel="canonical" href="/no">\';</script><link rel="canonical" href="/yes">', "/yes", "", ""),
    ('<script>"<link rel=canonical href=/no>"', "", "", ""),
    ('<title><link rel="canonical" href="/no"></title><STYLE><meta http-equiv=refresh content="0;url=/no"></STYLE>', "", "", ""),
    ('<linked rel="canonical" href="/no"><a rel="canonical" href="/no">', "", "", ""),
    ('<base href="/dir/"><base href="/other/"><link rel="canonical" href="x">', "x", "", "/dir/"),
    ('<meta content="5; URL=\'/t;id=1\' " http-equiv="Refresh">', "", "/t;id=1", ""),
    ('<meta http-equiv="refresh" content="30"><meta http-equiv="refresh" content="0;url=/t">', "", "/t", ""),
    ('<meta name="refresh" content="0;url=/no"><meta http-equiv="x-refresh" content="0;url=/no">', "", "", ""),
    ('<link rel="canonical" href="/a" href="/b" rel="x"/>', "/a", "", ""),
    ("", "", "", ""), ("<link", "", "", ""), ("no tags, canonical", "", "", ""), ("<link rel=canonical href='/a", "", "", ""),
]


@pytest.mark.parametrize("markup,canonical,refresh,base", PAGES)
def test_links_of_a_page(markup, canonical, refresh, base):
    assert url_filter.page_links(markup) == (canonical, refresh, base)


def test_a_long_page_is_scanned_once():
    filler = "<p title='x > y'>text</p>" * 40_000 + "<!-- c -->" * 10_000 + '"' * 2000 + "<link " * 2000
    assert url_filter.page_links(filler + '> <link rel="canonical" href="/end">')[0] in ("", "/end")


def plain_node(url):
    """Identity of a url by plain Python."""
    m = re.match(r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    if not m or not m[2]:
        return None
    port = {"http": ":80", "https": ":443"}.get(m[1].lower(), ":")
    where = m[2].lower()
    where = where.removesuffix(port) if where.endswith(port) else where.removesuffix(":")

    def escapes(t):
        return re.sub("%([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)) if re.match("[A-Za-z0-9._~-]$", chr(int(x[1], 16))) else "%" + x[1].upper(), t)

    path = escapes(m[3]) or "/"
    out = []
    parts = path.split("/")
    for k, p in enumerate(parts):
        if p == "..":
            out = out[:max(1, len(out) - 1)]
        elif p != ".":
            out.append(p)
        if p in (".", "..") and k == len(parts) - 1:
            out.append("")
    return where + "/".join(out) + escapes(m[4] or "")


URLS = ["http://a.org", "http://A.org:80/", "https://a.org:443/x", "https://a.org:80/x", "http://a.org:443/", "http://a.org:/x", "ftp://a.org:80/", "http://a.org/%65s/",
        "http://a.org/es/?q=%41%2f%zz%4", "http://a.org/a/../b/./c/..", "http://a.org/%2e%2E/x", "http://a.org/caf%c3%a9?%20", "http://a.org/%", "x://", "none", "",
        "http://a.org/x#f?y", "http://a.org?x=%7E", "HTTP://a.org:80", "http://a.org/%2F%3a"]


def test_identity_of_urls(spark):
    df = spark.createDataFrame([(u,) for u in [*URLS, None]], "url string")
    got = {r["url"]: r["n"] for r in df.select("url", url_filter.node(F.col("url")).alias("n")).collect()}
    assert got == {u: plain_node(u) for u in [*URLS, None]}


def test_verdicts_by_links_as_html_has_them(spark):
    """Aliases by way of base, lists of words, ports and escapes are blocked; comments and scripts block nothing."""
    block = "http://x.net/es/1"
    link = '<link rel="canonical" href="{}">'
    pages = [("http://r.org/1", f'<link data-href="/a" rel="nofollow canonical" title=">" href="{block}">', "block"),
             ("http://r.org/2", f"<!-- {link.format(block)} -->", "allow"), ("http://r.org/3", f"<script>'{link.format(block)}'</script>", "allow"),
             ("http://r.org/4", '<base href="http://x.net/es/">' + link.format("1"), "block"), ("http://r.org/5", link.format("http://x.net:80/%65s/1"), "block"),
             ("http://r.org/6", '<base href="//r.org/dir/">' + link.format("../1"), "block"), ("http://r.org/7", link.format("http://x.net:81/es/1"), "allow"),
             ("http://r.org/8", link.format("http://other.org/"), "allow"), ("http://r.org/9", None, "allow"), (None, link.format(block), "allow"),
             ("http://r.org/10/", '<meta http-equiv="refresh" content="0; url=../1">', "block")]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    got = url_filter.filter_urls(df, queries.URL_RULES, url_filter.html_links(df), Scratch(spark, "t")).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {i: v for i, (*_, v) in enumerate(pages)}
    none = df.where("false")
    assert url_filter.filter_urls(none, queries.URL_RULES, url_filter.html_links(none), Scratch(spark, "t")).collect() == []
