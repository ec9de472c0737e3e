"""Access-log reports against a plain-Python reading of the report rules, on random
lines (sites that are prefixes of each other, odd statuses, missing or non-numeric
request times, long paths, paged listings)."""

import random
import re
from collections import Counter, defaultdict
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.operators import traffic
from fleetlens.sources.parse import parse_access

SITES = ["s1", "s10", "s2"]
PATHS = ["/a", "/list?page=0", "/list?page=3", "/x/" + "y" * 60, "/cron.php"]
STATUSES = ["200", "304", "404", "500", "503", "511", "5", "abc"]


def make_lines(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        day, hh, mm = rnd.randint(1, 3), rnd.randint(0, 23), rnd.randint(0, 59)
        rt = rnd.choice([str(rnd.randint(0, 6_000_000)), "3000000", "3000001", None, "zz"])
        tail = f" request_time={rt}" if rt is not None else ""
        out.append(f'10.0.0.1 - - [{day:02d}/Jan/2024:{hh:02d}:{mm:02d}:00 +0000] "GET {rnd.choice(PATHS)} HTTP/1.1" '
                   f'{rnd.choice(STATUSES)} 1 "-" "{rnd.choice(["ua1", "Drupal x"])}" hosting_site={rnd.choice(SITES)}'
                   f'{tail} request_id="v-{i}"')
    return out


def py_hourly(lines, site):
    g = defaultdict(list)
    for ln in lines:
        if f"hosting_site={site} " not in ln or "request_time=" not in ln:
            continue
        m = re.search(r"request_time=([0-9]+)", ln)
        us = int(m.group(1)) if m else 0
        f = ln.split()
        hour = datetime.strptime(f[3][1:15], "%d/%b/%Y:%H")
        g[hour].append((us, f[8]))
    out = {}
    for h, rows in g.items():
        n = len(rows)
        cls = Counter(s[0] for _, s in rows)
        out[h] = (n, sum(u for u, _ in rows) / n / 1e6, max(u for u, _ in rows) / 1e6,
                  sum(u > 3_000_000 for u, _ in rows), cls["2"], cls["3"], cls["4"], cls["5"])
    return out


def py_error_paths(lines, k=5):
    c = Counter()
    for ln in lines:
        f = ln.split()
        if f[8][:2] == "50":
            c[f[6][:50] + ("..." if len(f[6]) > 50 else "")] += 1
    return sorted(c.items(), key=lambda kv: (-kv[1], [-ord(ch) for ch in kv[0]]))[:k]


def py_paged(lines):
    c = Counter(ln.split('"')[5] for ln in lines if re.search("page=[1-9]", ln))
    return dict(c)


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 150))
def test_reports_match_python(spark, seed, n):
    vals = make_lines(seed, n)
    acc = parse_access(spark.createDataFrame([("f", i, v) for i, v in enumerate(vals)], "file string, seq long, value string"))
    for site in ("s1", "s10"):
        got = {r.hour: (r.n_requests, r.avg_s, r.max_s, r.n_slow, r.n_2xx, r.n_3xx, r.n_4xx, r.n_5xx)
               for r in traffic.hourly_traffic(acc, site).collect()}
        assert got == py_hourly(vals, site)
    assert [(r.path, r.n) for r in traffic.top_error_paths(acc).collect()] == py_error_paths(vals)
    assert {r.user_agent: r.n for r in traffic.paged_hits_by_agent(acc, k=10).collect()} == py_paged(vals)


TYPES = ["php", "cron", "page not found", "user", "a|b"]
MSGS = ["m1", "m2 error", "Exception x", "m1"]


def make_watchdog(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if rnd.random() < 0.05:
            out.append("garbage line without separators")
            continue
        out.append(f"Jan 05 10:00:{i % 60:02d} h s: http://s|{i}|{rnd.choice(TYPES)}|ip|/p{rnd.randint(0, 3)}||1||"
                   f'{rnd.choice(MSGS)} request_id="v-{i}"')
    return out


def py_top_types(lines, k=5):
    c = Counter((ln.split("|")[2] if "|" in ln else ln) for ln in lines)
    return sorted(c.items(), key=lambda kv: (-kv[1], [-ord(ch) for ch in kv[0]]))[:k]


def py_top_messages(lines, n_types=2, k=5):
    types = [t for t, _ in py_top_types(lines)][:n_types]
    out = {}
    for t in types:
        c = Counter()
        for ln in lines:
            f = ln.split("|")
            t_ln = f[2] if "|" in ln else ln
            if t_ln == t:
                msg = f[8] if len(f) > 8 else None
                if msg is not None:
                    msg = re.sub(r' request_id="[^"]*"', "", msg, count=1)
                c[msg] += 1
        ranked = sorted(c.items(), key=lambda kv: (-kv[1], [-ord(ch) for ch in (kv[0] or "")]))[:k]
        out[t] = ranked
    return out


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 120))
def test_watchdog_reports_match_python(spark, seed, n):
    from fleetlens.operators import watchdog
    from fleetlens.sources.parse import parse_watchdog

    vals = make_watchdog(seed, n)
    df = parse_watchdog(spark.createDataFrame([("w", i, v) for i, v in enumerate(vals)],
                                              "file string, seq long, value string"))
    assert [(r.type, r.n) for r in watchdog.top_types(df).collect()] == py_top_types(vals)
    got = defaultdict(list)
    for r in watchdog.top_messages_per_type(df).orderBy("type", "rank").collect():
        got[r.type].append((r.message, r.n))
    exp = py_top_messages(vals)
    assert {t: v for t, v in exp.items() if all(m is not None for m, _ in v)} == \
        {t: v for t, v in got.items() if t in exp and all(m is not None for m, _ in exp[t])}


def awk_select_hosts(lines, include_marked):
    """The listing filter as the shell wrote it: egrep web-like, (egrep -v marked), awk show flag."""
    out, show, foundweb = [], True, False
    for i, ln in enumerate(lines):
        if not re.search("srv-|web-|ded-|staging-|managed-", ln):
            continue
        if not include_marked and re.search(r" (\*|†)", ln):
            continue
        if "web-" in ln:
            foundweb = True
        if "ded-" in ln and foundweb:
            show = False
        if show:
            out.append((i, ln.split()[0]))
    return out


def awk_passive_or_active(lines):
    passive = active = None
    flag = False
    for ln in lines:
        f = ln.split()
        if f and re.match(r"^[a-z]+-[0-9]+", f[0]):
            if flag:
                passive, flag = f[0], False
            if len(f) > 1 and f[1] == "active-db":
                active, flag = f[0], True
    return passive or active


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["srv", "web", "ded", "bal", "db", "staging"]),
                          st.sampled_from(["up", "active-db", "db"]), st.booleans()), min_size=1, max_size=25))
def test_listing_checks_match_awk(spark, rows):
    from fleetlens.operators import fleet

    lines = [f" {p}-{i} {state} 1{' *' if marked else ''}" for i, (p, state, marked) in enumerate(rows)]
    df = spark.createDataFrame([("l", i, v) for i, v in enumerate(lines)], "file string, seq long, value string")
    for marked in (False, True):
        got = [(r.seq, r.host) for r in fleet.select_hosts(df, include_marked=marked).orderBy("seq").collect()]
        assert got == awk_select_hosts(lines, marked)
    plain = [ln.strip() for ln in lines]
    df2 = spark.createDataFrame([("l", i, v) for i, v in enumerate(plain)], "file string, seq long, value string")
    r = fleet.passive_or_active(df2).collect()
    exp = awk_passive_or_active(plain)
    assert (r[0].chosen if r else None) == exp


CACHE_LINES = ["page_cache_maximum_age  0", "block  cache  0", "Enabled  none", "Enabled  yes", "DRUPAL_NO_CACHE  x",
               "Disabled  foo", "other"]


def awk_cache_audit(lines, head=10):
    out, highlight = [], False
    for i, ln in enumerate(lines):
        if re.search(r"page_cache_maximum_age  *0| cache  *0|Enabled  *($|none)|DRUPAL_NO_CACHE", ln):
            highlight = True
        if i < head:
            out.append((i, "head", False))
        if "Enabled" in ln:
            out.append((i, "enabled", highlight))
            highlight = False
    return sorted(out)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(CACHE_LINES), min_size=1, max_size=40))
def test_cache_audit_matches_awk(spark, lines):
    from fleetlens.operators import fleet

    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(lines)], "file string, seq long, value string")
    got = sorted((r.seq, r.kind, r.highlight) for r in fleet.cache_audit(df).collect())
    assert got == awk_cache_audit(lines)


def awk_process_capacity(lines, user):
    """Running processes of ``user`` per section (sections named alike merge)."""
    out, server = {}, None
    rows = [ln for ln in lines if "defunct" not in ln]
    sections = defaultdict(list)
    for ln in rows:
        if "[" in ln:
            server = ln[1:-1]
            sections.setdefault(server, [])
            continue
        if server is not None:
            sections[server].append(ln)
    for srv, body in sections.items():
        user_running = sum(1 for ln in body if ln.split()[:1] == [user] and len(ln.split()) > 1
                           and int(re.match(r"-?[0-9]*", ln.split()[1]).group() or 0) > 0)
        out[srv] = user_running
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.just("[srv-a]"), st.just("[srv-b]"), st.sampled_from(["u1 2 x", "u1 0 x", "u2 3 x",
                                                                                     "5 procs running", "x 1 defunct"])),
                min_size=1, max_size=40))
def test_process_capacity_sections_match(spark, lines):
    from fleetlens.operators import fleet

    df = spark.createDataFrame([("p", i, v) for i, v in enumerate(lines)], "file string, seq long, value string")
    got = defaultdict(int)
    for r in fleet.process_capacity(df, "u1").collect():  # one row a section; those of one name add up here
        got[r.server] += r.user_running
    assert got == awk_process_capacity(lines, "u1")
