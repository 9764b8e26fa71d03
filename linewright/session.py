"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    # Parsed timestamps are UTC wall clock, so the session must not shift them.
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles methods above 8000 bytes. A stage of many regex columns that
    # would exceed it runs faster with its expressions compiled one by one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Arrow batches of whole documents are bounded by rows first.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Put the settings on a session that was made elsewhere; they stay set after a query.

    A local session without spark.checkpoint.dir gets a temporary folder, since driver and executors are one process there. Python
    workers of a local session find this package where the driver did; on a cluster it is shipped with --py-files.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="linewright-"))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def build_session(app_name: str = "linewright", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session with the settings above; `extra` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
