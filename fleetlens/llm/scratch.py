"""Written intermediate tables: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import ship_package


def shared_base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where it is unset and the master is ``local[...]`` (tests), a temporary folder is
    used; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Tables of one operator run in a folder of its own below the shared folder.

    ``write`` stores a DataFrame and returns it as read back; ``drop`` deletes tables
    that nothing needs any more; ``finish`` stores the result and deletes the others.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.root = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.tables: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        schema = df.schema
        df.write.option("compression", codec).parquet(path)
        self.tables[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` itself where it is read straight from files, which gives the same rows in the same
        partitions each time; else as written: rows that come from a shuffle may change their places."""
        straight = df.inputFiles() and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        return df if straight else self.write(df, name)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.tables.pop(name, None):
                delete(self.spark, path)

    def finish(self, df: DataFrame) -> DataFrame:
        out = self.write(df, "result")
        self.drop(*(n for n in list(self.tables) if n != "result"))
        return out


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, which also reaches remote stores."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
