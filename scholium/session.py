"""Session helpers: settings for large runs and reliable lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution splits skewed joins and coalesces small partitions; UTC keeps dates stable.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "scholium", **settings: str) -> SparkSession:
    """A session with :data:`SETTINGS`, further settings last."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Reliable checkpoint in ``spark.checkpoint.dir``; a folder of our own only where that is unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            configured = tempfile.mkdtemp(prefix="scholium-checkpoint-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        sc.setCheckpointDir(configured)
    return df.checkpoint(eager=True)
