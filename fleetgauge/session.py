"""Session settings the operators rely on, and the shared folder for written intermediates."""

from __future__ import annotations

import os
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # log timestamps carry no zone; epoch arithmetic on them is done in UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # sizes are of compressed rows, which take up to forty times as much in a sort or a hash table
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join input even when a later aggregate then needs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session the caller already built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the executors, once a session, as ``--py-files`` would: for functions that run there."""
    context, home = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if not any(os.path.basename(f) == "fleetgauge.zip" for f in context._python_includes):
        archive = os.path.join(SparkFiles.getRootDirectory(), "package", "fleetgauge.zip")
        os.makedirs(os.path.dirname(archive), exist_ok=True)
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(home):
                for full in (os.path.join(folder, n) for n in names if n.endswith(".py")):
                    out.write(full, os.path.relpath(full, os.path.dirname(home)))
        context.addPyFile(archive)
    return spark


def filter_at_scans(spark: SparkSession, *, small_mb: int = 64, large_mb: int = 1024) -> SparkSession:
    """Let a join's small side cut down the scan of its large one by a Bloom filter of the keys, before the shuffle.

    Made for the logs without a time of their own (plans, steps, metrics): the reports join them to the statements of a
    window, and only rows of those statements leave the scan. Spark builds the filter only where the bounded side is
    estimated at ``small_mb`` at most and the scan at ``large_mb`` at least, and never beyond its size limit.
    """
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", f"{small_mb}m")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", f"{large_mb}m")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder every executor can reach (``spark.checkpoint.dir``).

    A session without that setting uses a folder below its warehouse, which is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_intermediate")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
