"""URL filters with redirect equivalence.

A url's own rule is the longest one that fits its host and path.  Urls that redirect to each
other, or name each other as canonical, are aliases: connected components over those edges,
found by a distributed algorithm.  A block decision holds for all aliases without a rule of
their own, unless one of the aliases is explicitly allowed: explicit allow takes precedence.

Links are read as html has them, in Arrow batches of the pages whose markup names one: tags in
comments, scripts, styles and other raw text are none; attributes are told apart by whole names,
the first of a name counts, and their values end at their own quote, whatever else they hold; ``rel`` is a
list of words; character references are decoded; a refresh target is the rest of its attribute or ends at
a quote of its own; links are relative to the page's ``base``, if it has one.  The first
canonical link and the first refresh with a target count.  Dot segments, the scheme's own port, and escapes of
characters that need none make no difference to a url's identity.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, no
aliases and is allowed; repeated pages are judged alike; links that are null, empty or to the
page itself add nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Sequence
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.components import connected_components
from fleetlens.llm.scratch import Scratch
from fleetlens.llm.words import trimmed
from fleetlens.session import ship_package

AUTHORITY = r"^[\s\S]*?://([^/?#]*)"
PATH = r"^[\s\S]*?://[^/?#]*([^?#]*)"
QUERY = r"^[^#]*?(\?[^#]*)"
# one match for each comment, raw text, or tag that may hold a link
MARKUP = re.compile(
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)"
    r"|<(link|meta|base)(?=[\s/>])((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>")
ATTRIBUTE = re.compile(r"""(?s)([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
REFRESH_URL = re.compile(r"""(?is)\burl\s*=\s*(?:"([^"]*)|'([^']*)|(.*))""")
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|([A-Za-z][A-Za-z0-9]*;?)(?!=))")
DOTS = r"/\.{1,2}(/|$)"


def decoded(value: str) -> str:
    """An attribute's value with its character references decoded, as html defines it for attributes.

    Names without ``;`` stay where a letter, digit or ``=`` follows, as in ``?a=1&copy=2``.
    """
    return REFERENCE.sub(lambda m: html.unescape(m[0]) if m[1] is None else html5.get(m[1], m[0]), value)


def _attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by their names in lower case, the first of each name."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), decoded(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def _stripped(link: str) -> str:
    return re.sub(r"[\t\n\r]", "", link).strip(" \x0b\x0c")


def page_links(markup: str) -> tuple[str, str, str]:
    """The canonical link, the refresh target and the base of a page, each empty where there is none."""
    canonical = refresh = base = ""
    for m in MARKUP.finditer(markup):
        if not m[2]:
            continue
        tag, a = m[2].lower(), _attributes(m[3])
        if tag == "base":
            base = base or _stripped(a.get("href", ""))
        elif tag == "link" and not canonical and "canonical" in a.get("rel", "").lower().split():
            canonical = _stripped(a.get("href", ""))
        elif tag == "meta" and not refresh and a.get("http-equiv", "").strip().lower() == "refresh":
            found = REFRESH_URL.search(a.get("content", ""))
            refresh = _stripped(next((g for g in found.groups() if g is not None), "")) if found else ""
    return canonical, refresh, base


def resolved(link: str, base: str) -> str | None:
    """Absolute form of a link at ``base``, its dot segments applied; None without a link or a base."""
    found = re.match(r"(?s)([^:]*)://([^/?#]*)([^?#]*)", base)
    if not link:
        return None
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", link):
        if not found:
            return None
        site = f"{found[1]}://{found[2]}"
        if link.startswith("//"):
            link = f"{found[1]}:{link}"
        elif link.startswith("/"):
            link = site + link
        elif link[0] in "?#":
            link = site + found[3] + link
        else:
            link = site + (found[3][:found[3].rfind("/") + 1] or "/") + link
    before, path_, behind = re.match(r"(?s)([^:]*://[^/?#]*)([^?#]*)(.*)", link).groups()
    kept: list[str] = []
    segments = path_.split("/")
    for k, segment in enumerate(segments):
        plain = re.sub("(?i)%2e", ".", segment)
        if plain == "..":
            kept = kept[:max(1, len(kept) - 1)]
        elif plain != ".":
            kept.append(segment)
        if plain in (".", "..") and k == len(segments) - 1:
            kept.append("")
    return before + "/".join(kept) + behind


@trimmed
def _found_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for src, markup in zip(b.column("src").to_pylist(), b.column("html").to_pylist()):
            canonical, refresh, base = page_links(markup)
            base = resolved(base, src) or src
            rows += [(src, resolved(link, base)) for link in (canonical, refresh) if link]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["src", "dst"])


def host(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), AUTHORITY, 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_dots(path_: Column) -> Column:
    """A path with its ``.`` and ``..`` segments applied; it never leaves the root."""
    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(segment == ".", kept).when(segment == "..", up).otherwise(F.concat(kept, F.array(segment)))

    def applied(p: Column) -> Column:
        end = F.when(F.regexp_like(p, F.lit(r"/\.{1,2}$")), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        kept = F.aggregate(F.concat(F.split(p, "/"), end), F.array().cast("array<string>"), step)
        return F.when(F.regexp_like(p, F.lit(DOTS)), F.array_join(kept, "/")).otherwise(p)

    return _let(path_, applied)


def plain_escapes(text: Column) -> Column:
    """Escapes of letters, digits and ``-._~`` as these characters, others with capital digits."""
    def piece(t: Column, i: Column) -> Column:
        hexed = F.regexp_like(t, F.lit("^[0-9A-Fa-f]{2}"))
        sign = F.char(F.conv(F.substring(t, 1, 2), 16, 10).cast("long"))
        rest = F.substr(t, F.lit(3))
        escaped = F.when(F.regexp_like(sign, F.lit("^[A-Za-z0-9._~-]$")), F.concat(sign, rest)).otherwise(
            F.concat(F.lit("%"), F.upper(F.substring(t, 1, 2)), rest))
        return F.when(i == 0, t).when(hexed, escaped).otherwise(F.concat(F.lit("%"), t))

    return _let(text, lambda t: F.when(F.contains(t, F.lit("%")), F.array_join(F.transform(F.split(t, "%"), piece), "")).otherwise(t))


def node(url: Column) -> Column:
    """Identity of a url: host without its scheme's own port, path without dot segments, and query, in plain
    escapes; scheme and fragment make no difference.  Null without host."""
    scheme = F.lower(F.regexp_extract(url, r"^([^:]*)://", 1))
    own_port = F.when(scheme == "http", r":(80)?$").when(scheme == "https", r":(443)?$").otherwise(":$")
    where = F.regexp_replace(host(url), own_port, F.lit(""))
    below = F.when(path(url) == "", F.lit("/")).otherwise(without_dots(plain_escapes(path(url))))
    return F.when(host(url) != "", F.concat(where, below, plain_escapes(F.regexp_extract(url, QUERY, 1))))


def html_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) urls of canonical links and refresh redirects in the pages' html."""
    ship_package(pages.sparkSession)
    some = pages.select(F.col(url_col).alias("src"), F.col(html_col).alias("html")).where(F.col("html").rlike("(?i)canonical|refresh"))
    return some.where("src is not null").mapInArrow(_found_links, "src string, dst string").where("dst is not null")


def own_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, below = rule.partition("/")
        fits = ((host_ == at) | host_.endswith("." + at)) & path_.startswith("/" + below)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], links: DataFrame, scratch: Scratch,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.  ``rules``: (allow or block, host/path); ``links``: (src, dst) urls."""
    judged = own_rule(F.col("host"), F.col("path"), rules)

    def parts(df: DataFrame) -> DataFrame:
        return df.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("own", judged)

    edges = scratch.write(links.where(node(F.col("src")) != node(F.col("dst"))).distinct(), "links")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("url"))
    named = parts(ends).select(node(F.col("url")).alias("node"), F.col("own.verdict").alias("verdict")).distinct()
    groups = connected_components(edges.select(node(F.col("src")).alias("u"), node(F.col("dst")).alias("v")), scratch)
    member = groups.join(named, "node")
    votes = member.groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allow"), F.max(F.col("verdict") == "block").alias("block"))
    blocked = votes.where("block and not coalesce(allow, false)").select("component")
    aliases = groups.join(blocked, "component").select("node", F.lit("block").alias("by_alias"))
    rows = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))).withColumn("node", node(F.col("url")))
    out = rows.join(aliases, "node", "left")
    return out.select(F.col("page_id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"),
                      F.coalesce(F.col("own.verdict"), "by_alias", F.lit("allow")).alias("verdict"))
