"""Session helpers: UTC clock, sane local defaults, and a shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "fleetlens", shuffle_partitions: int | None = None,
                driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every report assumes.

    Log times are GMT+0, so the session clock is pinned to UTC.  AQE stays on so
    joins against small per-file / per-chunk tables become broadcasts only after
    their real size is known.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.unionOutputPartitioning", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a large cluster, derived from the input size and core count.

    * Scan splits of 256 MiB: few enough tasks for 100 TB (~400k), small enough to
      stream through one core's memory.  gzip files are one split each regardless.
    * Initial shuffle partitions sized for ~256 MiB of map output each when no
      aggregation shrinks the data (AQE coalesces down when it does), at least 4x
      the cores.
    * AQE skew join splits partitions 4x over the median and over 512 MiB.
    * Broadcast threshold 64 MiB: per-file layout flags, per-chunk summaries and
      per-listing aggregates stay broadcast at fleet scale (measured at run time).
    """
    parts = max(4 * cores, input_bytes // (256 << 20))
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.unionOutputPartitioning": "false",
    }


def apply_conf(spark: SparkSession, conf: dict[str, str]) -> None:
    """Apply runtime SQL settings (all of ``cluster_conf`` are runtime settings)."""
    for k, v in conf.items():
        spark.conf.set(k, v)


def ensure_utc(spark: SparkSession) -> None:
    """Log timestamps carry +0000; render and bucket them in UTC."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession, name: str = "") -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names storage every executor can reach.  Where it is unset,
    a ``local[...]`` master (tests) gets a temporary folder, which is removed when the
    driver ends; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="fleetlens-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = _LOCAL[0]
    return os.path.join(base, f"{name or 'run'}-{uuid.uuid4().hex[:12]}")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once.

    Functions that run in workers are pickled by name.  Where the package is not installed on the
    executors, and the driver started in another folder, their modules are found only so."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="fleetlens-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(folder, "fleetlens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for where, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(where, name)
                    z.write(file, os.path.join("fleetlens", os.path.relpath(file, package)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
