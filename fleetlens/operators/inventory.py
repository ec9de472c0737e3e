"""Nested fleet inventory (OP-09): realm -> environment -> zone -> host -> roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = T.StructType([T.StructField("type", T.ArrayType(T.StringType()))])
INVENTORY = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), LEAF))))
DASHBOARD_ROLES = ["bal", "web", "db"]


def flatten_inventory(df: DataFrame, col: str = "json", schema: T.DataType = INVENTORY) -> DataFrame:
    """JSON documents -> one row per host: realm, env, zone, host, role (first type)."""
    d = df.select(F.from_json(col, schema).alias("_doc"))
    d = d.select(F.explode("_doc").alias("realm", "_envs"))
    d = d.select("realm", F.explode("_envs").alias("env", "_zones"))
    d = d.select("realm", "env", F.explode("_zones").alias("zone", "_hosts"))
    d = d.select("realm", "env", "zone", F.explode("_hosts").alias("host", "_data"))
    return d.select("realm", "env", "zone", "host", F.get(F.col("_data.type"), 0).alias("role"))


def hosts_by_role(flat: DataFrame, roles=DASHBOARD_ROLES) -> DataFrame:
    """(role, host) for the dashboard roles, ordered by role then host.  Kept as rows
    (a global sort) rather than one list per role, so no role is gathered in a task."""
    return flat.filter(F.col("role").isin(list(roles))).select("role", "host").orderBy("role", "host")
