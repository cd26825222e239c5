"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def local_session(cores: str = "8", app: str = "kadence", **extra: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter makes the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.showConsoleProgress", "false")
        # The default of 1 MB leaves test tables in a single task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    if "spark.checkpoint.dir" not in extra:
        # One machine: its temporary folder is shared by all there is.
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="kadence-")
    extra.setdefault("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> SparkSession:
    """Years and dates are taken in UTC, whatever zone the submitter's machine has."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
