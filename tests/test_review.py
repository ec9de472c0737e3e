import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.operators import review

RANK = {"REQUESTED": 0, "COMMENTED": 1, "APPROVED": 2, "CHANGES_REQUESTED": 2, "DISMISSED": 2}
STATES = ["COMMENTED", "APPROVED", "CHANGES_REQUESTED", "DISMISSED", "PENDING"]
T0 = dt.datetime(2024, 1, 1)


def loop_fold(requested, reviews):
    """The review-state fold exactly as a plain loop (PHP comparison rules)."""
    out = {}
    for repo, number, uid, login in requested:
        out[(repo, number, uid)] = (login, "REQUESTED", None)
    for seq, repo, number, uid, login, state, t in sorted(reviews):
        key = (repo, number, uid)
        if key in out:
            cur = out[key]
            if t is None or (cur[2] is not None and t <= cur[2]):
                continue
            if RANK.get(state, 0) < RANK.get(cur[1], 0):
                continue
        out[key] = (login, state, t)
    return out


def frames(spark, requested, reviews):
    req = spark.createDataFrame(requested, "repo string, number long, user_id long, login string")
    rev = spark.createDataFrame(reviews, "seq long, repo string, number long, user_id long, login string, state string, "
                                         "submitted_at timestamp_ntz")
    return req, rev


def _collect(df):
    return {(r.repo, r.number, r.user_id): (r.login, r.state, r.submitted_at) for r in df.collect()}


def _random_case(rnd, chronological):
    requested = [("r", n, u, f"u{u}") for n in range(3) for u in range(3) if rnd.random() < 0.4]
    reviews = []
    for seq in range(40):
        n, u = rnd.randrange(3), rnd.randrange(3)
        if chronological:
            t = T0 + dt.timedelta(minutes=seq)
        else:
            t = rnd.choice([None, T0 + dt.timedelta(minutes=rnd.randrange(10))])
        reviews.append((seq, "r", n, u, f"u{u}", rnd.choice(STATES), t))
    return requested, reviews


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10_000))
def test_fast_form_equals_fold_on_chronological_input(spark, seed):
    requested, reviews = _random_case(random.Random(seed), True)
    req, rev = frames(spark, requested, reviews)
    exp = loop_fold(requested, reviews)
    assert _collect(review.review_state(req, rev)) == exp
    assert _collect(review.review_state(req, rev, in_order=True)) == exp


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10_000))
def test_exact_form_equals_fold_on_any_input(spark, seed):
    requested, reviews = _random_case(random.Random(seed), False)
    req, rev = frames(spark, requested, reviews)
    exp = loop_fold(requested, reviews)
    assert _collect(review.review_state(req, rev)) == exp


def _php_nearest(hexcolor):
    r, g, b = (int(hexcolor[i:i + 2], 16) for i in (0, 2, 4))
    best, closest = None, None
    for name, pr, pg, pb in review.PALETTE:
        d = ((r - pr) ** 2 + (g - pg) ** 2 + (b - pb) ** 2) ** 0.5
        if closest is None or d < closest:
            closest, best = d, name
    return best, ("black" if best in ("yellow", "green", "white") else "white")


def test_nearest_color_matches_loop(spark):
    rnd = random.Random(5)
    colors = [f"{rnd.randrange(1 << 24):06x}" for _ in range(3000)] + ["000000", "ffffff", "5c5cff", "7f7f7f", "808080"]
    df = spark.createDataFrame([(c,) for c in colors], "color string")
    got = {r.color: (r.bg, r.fg) for r in review.nearest_color(df).collect()}
    assert all(got[c] == _php_nearest(c) for c in colors)


def test_queue_filters(spark):
    iss = spark.createDataFrame(
        [("r", 1, "t1", T0, (9, "author"), [("bug", "ff0000")], ("u1",)),
         ("r", 2, "t2", T0, (9, "author"), [], ("u2",)),
         ("r", 3, "t3", T0, (9, "author"), [], None),
         ("r", 4, "t4", T0 - dt.timedelta(days=40), (9, "author"), [], ("u4",))],
        "repo string, number long, title string, updated_at timestamp_ntz, user struct<id:long,login:string>, "
        "labels array<struct<name:string,color:string>>, pull_request struct<html_url:string>")
    reqs, revs = frames(spark, [("r", 1, 5, "me")], [
        (1, "r", 1, 5, "me", "APPROVED", T0), (2, "r", 2, 1, "a", "APPROVED", T0), (3, "r", 2, 2, "b", "APPROVED", T0),
        (4, "r", 2, 9, "author", "APPROVED", T0)])
    q = review.review_queue(iss, reqs, revs, since=str(T0 - dt.timedelta(days=14)), me="me", min_approvals=3)
    assert [r.number for r in q.collect()] == []  # 1 approved by me, 2 has 3 approvals (author counts), 3 is an issue
    q = review.review_queue(iss, reqs, revs, since=None, me=None, min_approvals=None).orderBy("number").collect()
    assert [r.number for r in q] == [1, 2, 4]
    assert q[1].reviewers == "a:APPROVED b:APPROVED" and q[0].labels == "bug"


def test_outdated_boundary(spark):
    now = "2024-03-01 00:00:00"
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 31)), ("b", dt.datetime(2024, 1, 29, 23, 59)),
                                ("b", dt.datetime(2023, 1, 1))], "repo string, committed_at timestamp_ntz")
    r = review.outdated(df, now).collect()
    assert [(x.repo, x.days) for x in r] == [("b", 31)]  # exactly 30 days is not outdated
