"""Review-queue analytics over issue, pull-request and review records (OP-59..OP-67).

Three DataFrames (issues, requested reviewers, reviews) are joined once; there is no
call per pull request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["repo", "number"]

# Review state ranks, console palette and contrast rule.
STATE_RANK = {"REQUESTED": 0, "COMMENTED": 1, "APPROVED": 2, "CHANGES_REQUESTED": 2, "DISMISSED": 2}
PALETTE = [
    ("black", 0, 0, 0),
    ("red", 255, 0, 0),
    ("green", 0, 255, 0),
    ("yellow", 255, 255, 0),
    ("blue", 92, 92, 255),
    ("magenta", 255, 0, 255),
    ("cyan", 0, 255, 255),
    ("white", 255, 255, 255),
]
DARK_TEXT_ON = ["yellow", "green", "white"]
MIN_APPROVALS = 3


def pull_requests(df: DataFrame) -> DataFrame:
    """Issues that are pull requests."""
    return df.filter(F.col("pull_request").isNotNull())


def open_issues(df: DataFrame) -> DataFrame:
    """Issues that are not pull requests."""
    return df.filter(F.col("pull_request").isNull())


def recent(df: DataFrame, since: str | None, col: str = "updated_at") -> DataFrame:
    """Drop records updated before ``since`` (no filter when ``since`` is None)."""
    if since is None:
        return df
    return df.filter(F.col(col) >= F.lit(since).cast("timestamp_ntz"))


def state_rank(col: str | Column = "state") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    expr = F.lit(0)
    for name, rank in STATE_RANK.items():
        expr = F.when(c == name, rank).otherwise(expr)
    return expr


def review_state(requested: DataFrame, reviews: DataFrame, in_order: bool = False) -> DataFrame:
    """Current review state per (repo, number, reviewer).

    Requested reviewers start as ``REQUESTED`` (no time).  Reviews are then folded in
    API order (``seq``): a review is skipped when it is not newer than the current
    entry (a review without a time never is) or ranks lower (REQUESTED 0, COMMENTED 1,
    others 2; unknown states 0).

    The fold is one aggregate per group over its reviews sorted by ``seq``; a group is
    one reviewer on one pull request.  ``in_order`` trusts the caller that every group's
    times strictly increase in ``seq``: the fold then is the latest review of the
    highest rank, a partial aggregate that combines map-side.
    """
    keys = KEYS + ["user_id"]
    seeds = requested.select(*keys, "login", F.lit("REQUESTED").alias("state"),
                             F.lit(None).cast("timestamp_ntz").alias("submitted_at"), F.lit(-1).cast("long").alias("seq"))
    revs = reviews.select(*keys, "login", "state", F.col("submitted_at").cast("timestamp_ntz").alias("submitted_at"),
                          F.col("seq").cast("long"))
    return _fold_fast(seeds, revs, keys) if in_order else _fold_exact(seeds, revs, keys)


def _fold_fast(seeds: DataFrame, revs: DataFrame, keys: list[str]) -> DataFrame:
    allr = seeds.unionByName(revs).withColumn("_rank", state_rank())
    best = allr.groupBy(*keys).agg(
        F.max_by(F.struct("login", "state", "submitted_at"), F.struct("_rank", "seq")).alias("_b"))
    return best.select(*keys, "_b.login", "_b.state", "_b.submitted_at")


def _fold_exact(seeds: DataFrame, revs: DataFrame, keys: list[str]) -> DataFrame:
    entry = F.struct(F.col("seq"), state_rank().alias("rank"), "submitted_at", "state", "login")
    folded = (revs.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_rs"))
              .join(seeds.select(*keys, F.struct(F.lit(True).alias("present"), F.lit(0).alias("rank"),
                                                 "submitted_at", "state", "login").alias("_seed")),
                    keys, "full"))
    empty = F.struct(F.lit(False).alias("present"), F.lit(0).alias("rank"),
                     F.lit(None).cast("timestamp_ntz").alias("submitted_at"), F.lit(None).cast("string").alias("state"),
                     F.lit(None).cast("string").alias("login"))

    def step(acc, x):
        skip_time = x.submitted_at.isNull() | (acc.submitted_at.isNotNull() & (x.submitted_at <= acc.submitted_at))
        skip = acc.present & (skip_time | (x["rank"] < acc["rank"]))
        new = F.struct(F.lit(True).alias("present"), x["rank"].alias("rank"), x.submitted_at.alias("submitted_at"),
                       x.state.alias("state"), x.login.alias("login"))
        return F.when(skip, acc).otherwise(new)

    init = F.coalesce(F.col("_seed"), empty)
    arr_type = "array<struct<seq:bigint,rank:int,submitted_at:timestamp_ntz,state:string,login:string>>"
    res = folded.select(*keys, F.aggregate(F.coalesce(F.col("_rs"), F.array().cast(arr_type)), init, step).alias("_f"))
    return res.select(*keys, "_f.login", "_f.state", "_f.submitted_at")


def not_approved_by(prs: DataFrame, states: DataFrame, login: str) -> DataFrame:
    """Pull requests ``login`` has not approved (anti join)."""
    mine = states.filter((F.col("login") == login) & (F.col("state") == "APPROVED")).select(*KEYS)
    return prs.join(mine, KEYS, "left_anti")


def below_min_approvals(prs: DataFrame, states: DataFrame, k: int | None = MIN_APPROVALS) -> DataFrame:
    """Pull requests with fewer than ``k`` approvals (the author's own counts)."""
    if k is None:
        return prs
    approvals = states.filter(F.col("state") == "APPROVED").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    return prs.join(approvals, KEYS, "left").filter(F.coalesce("_n", F.lit(0)) < k).drop("_n")


def reviewer_summary(prs: DataFrame, states: DataFrame) -> DataFrame:
    """``login:STATE`` of each reviewer, sorted by login, author left out.  The list
    per pull request is bounded by its number of distinct reviewers."""
    authors = prs.select(*KEYS, F.col("user.id").alias("_author"))
    rows = states.join(authors, KEYS).filter(F.col("user_id") != F.col("_author"))
    return rows.groupBy(*KEYS).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("login", "state"))),
                                 lambda x: F.concat(x.login, F.lit(":"), x.state)), " ").alias("reviewers"))


def review_queue(issues: DataFrame, requested: DataFrame, reviews: DataFrame, since: str | None = None,
                 me: str | None = None, min_approvals: int | None = MIN_APPROVALS) -> DataFrame:
    """Open pull requests still needing review, with labels and reviewer states.

    The three per-PR facts the filters and the display need - approved by ``me``,
    number of approvals, reviewer list without the author - come from one aggregate
    over the folded states (the author's id joined in), then one join with the PRs;
    the same answers as ``not_approved_by``, ``below_min_approvals`` and
    ``reviewer_summary`` one after the other, with one shuffle instead of three."""
    prs = recent(pull_requests(issues), since)
    authors = prs.select(*KEYS, F.col("user.id").alias("_author"))
    # only requests and reviews of the selected pull requests are folded
    selected = prs.select(*KEYS)
    states = review_state(requested.join(selected, KEYS, "left_semi"), reviews.join(selected, KEYS, "left_semi")).join(authors, KEYS)
    approved = F.col("state") == "APPROVED"
    others = F.collect_list(F.when(F.col("user_id") != F.col("_author"), F.struct("login", "state")))
    per_pr = states.groupBy(*KEYS).agg(
        F.count_if(approved).alias("_approvals"),
        F.bool_or(approved & (F.col("login") == F.lit(me))).alias("_mine") if me is not None
        else F.lit(False).alias("_mine"),
        others.alias("_others"))
    per_pr = per_pr.withColumn("reviewers", F.when(F.size("_others") > 0, F.array_join(
        F.transform(F.sort_array("_others"), lambda x: F.concat(x.login, F.lit(":"), x.state)), " ")))
    out = prs.join(per_pr, KEYS, "left")
    if me is not None:
        out = out.filter(~F.coalesce(F.col("_mine"), F.lit(False)))
    if min_approvals is not None:
        out = out.filter(F.coalesce(F.col("_approvals"), F.lit(0)) < min_approvals)
    return out.select(*KEYS, "title", F.col("user.login").alias("author"),
                      F.array_join(F.transform("labels", lambda x: x["name"]), ", ").alias("labels"),
                      "reviewers", F.col("pull_request.html_url").alias("html_url"))


def nearest_color(df: DataFrame, col: str = "color") -> DataFrame:
    """Label colour -> nearest console colour by RGB distance (first minimum wins)
    as ``bg``, and ``fg`` black on yellow/green/white, else white."""
    c = F.col(col)
    rgb = [F.conv(F.substring(c, 1 + 2 * i, 2), 16, 10).try_cast("int") for i in range(3)]
    cands = F.array(*[
        F.struct(((rgb[0] - r) * (rgb[0] - r) + (rgb[1] - g) * (rgb[1] - g) + (rgb[2] - b) * (rgb[2] - b)).alias("d"),
                 F.lit(i).alias("i"), F.lit(name).alias("name"))
        for i, (name, r, g, b) in enumerate(PALETTE)])
    bg = F.array_min(cands)["name"]
    return (df.withColumn("bg", bg)
            .withColumn("fg", F.when(F.col("bg").isin(DARK_TEXT_ON), "black").otherwise("white")))


def outdated(commits: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Repositories whose newest commit is more than ``days`` whole days old."""
    now_s = F.unix_seconds(F.lit(now).cast("timestamp_ntz").cast("timestamp"))
    last = commits.groupBy("repo").agg(F.max("committed_at").alias("last_commit"))
    age = F.floor((now_s - F.unix_seconds(F.col("last_commit").cast("timestamp"))) / 86400).cast("long")
    return last.withColumn("days", age).filter(F.col("days") > days).orderBy("days", "repo")
