"""Session helper for local runs and tests; on a cluster the session comes from the submitter."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of one Arrow batch, where the session has Spark's own 64 MB: long texts in several workers of one executor add up.
ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_DEFAULT, ARROW_BYTES = "67108864", 8 << 20


def share_package(spark: SparkSession) -> SparkSession:
    """Let Python workers that see this file system import the package, and bound Arrow batches unless the session has a
    setting of its own. Entry points call it; operators leave the session as it is. On a cluster ship the package with
    --py-files."""
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parent.parent)
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = f"{root}:{known}" if known else root
    if spark.conf.get(ARROW).rstrip("b") == ARROW_DEFAULT:
        spark.conf.set(ARROW, str(ARROW_BYTES))
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("frameloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in more.items():
        builder = builder.config(key, value)
    return share_package(builder.getOrCreate())
