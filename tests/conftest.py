import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    ckpt = tempfile.mkdtemp(prefix="fleetlens-test-")
    s = (SparkSession.builder.master("local[4]").appName("fleetlens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.checkpoint.dir", ckpt)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def lines(spark):
    """Build a (file, seq, value) frame from a list of strings (seq = position)."""
    def make(values, file="f.log", host=None):
        rows = [(file, i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "file string, seq long, value string")
        if host is not None:
            from pyspark.sql import functions as F
            df = df.withColumn("host", F.lit(host))
        return df
    return make
