"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as ent
from fleetlens.plans.oracle_sql import ORACLES
from fleetlens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(ent.queries()) >= set(QUERIES) and set(ent.oracle_sql()) >= set(ORACLES)


def test_entry_smoke(spark):
    df = ent.entry(spark)
    assert df.count() > 0 and "hour" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    cols = sorted(sdf.columns)
    got = sorted((tuple(_norm(x) for x in r) for r in sdf.select(*cols).collect()), key=repr)
    rel = con.execute(ORACLES[name])
    dcols = [d[0] for d in rel.description]
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    assert [dcols[i] for i in order] == cols
    exp = sorted((tuple(_norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert got == exp


@pytest.mark.parametrize("name", ["hourly_traffic", "syslog_events", "flush_ages", "outdated", "review_state"])
def test_query_independent_of_session_zone_and_ansi(spark, con, name):
    """A caller's session may start in another time zone with ANSI off; logs are UTC."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled")}
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        sdf = QUERIES[name](spark, SF)
        cols = sorted(sdf.columns)
        got = sorted((tuple(_norm(x) for x in r) for r in sdf.select(*cols).collect()), key=repr)
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    rel = con.execute(ORACLES[name])
    dcols = [d[0] for d in rel.description]
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    assert got == sorted((tuple(_norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
