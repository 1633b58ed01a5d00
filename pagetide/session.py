"""Session helper with the settings the jobs in this package expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Kept low enough to be safe everywhere; AQE picks the real partition counts.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    # Call-site capture makes building large expressions several times slower.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def open_session(app: str = "pagetide", **overrides: str) -> SparkSession:
    """Return a session; master and memory come from spark-submit unless overridden."""
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" in os.environ:
        builder = builder.master(os.environ["SPARK_MASTER"])
    for key, value in {**_DEFAULTS, **overrides}.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """Shared folder the cluster names for checkpoints, if it names one."""
    return spark.conf.get("spark.checkpoint.dir", None)
