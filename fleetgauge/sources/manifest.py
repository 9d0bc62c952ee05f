"""Manifest-driven loads: exactly the listed files, failing when a mandatory one is absent."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .listing import listed

ENTRY = "entries array<struct<url: string, mandatory: boolean>>"


def write_manifest(files: DataFrame, path: str) -> None:
    """Store a manifest; ``files`` has ``url`` and ``mandatory``. One line per entry, written in parallel."""
    files.select(F.array(F.struct("url", "mandatory")).alias("entries")).write.mode("overwrite").json(path)


def manifest_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).option("multiLine", False).json(path).select(F.inline("entries")).select(
        "url", F.coalesce("mandatory", F.lit(False)).alias("mandatory"))


def load_manifest(spark: SparkSession, path: str, read: Callable[[list[str]], DataFrame]) -> DataFrame:
    """Read exactly the files a manifest lists with ``read``.

    The list of names is what any multi-file read hands to Spark; the files stay on the executors.
    Spark checks the mandatory ones itself; optional entries are compared with a listing of each folder that has any,
    made by the executors, and only those that exist reach the driver.
    """
    entries = manifest_entries(spark, path).groupBy("url").agg(F.max("mandatory").alias("mandatory"))
    optional = entries.where("not mandatory").select("url", F.regexp_extract("url", "^(.*)/[^/]*$", 1).alias("folder"),
                                                     F.substring_index("url", "/", -1).alias("name"))
    there = optional.join(listed(optional), ["folder", "name"], "left_semi")
    wanted = [r.url for r in entries.where("mandatory").select("url").union(there.select("url")).toLocalIterator()]
    try:
        return read(sorted(wanted))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"a mandatory file of the manifest is absent: {e}") from e
        raise


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file at once: it is written beside and then renamed over the old one."""
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    target, beside = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    context = hadoop.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(beside), system.makeQualified(target), options)


def publish(spark: SparkSession, path: str, export: Callable[[str], DataFrame]) -> DataFrame:
    """Run ``export`` (a function from a folder to the manifest of the files it wrote there) and make its files the ones readers see.

    Every export gets a folder of its own below ``path``. Its manifest is written when all files are there, and one small
    file that names the manifest is replaced last: until then readers see the export before, or none. An export that dies
    leaves files that nobody reads. Returns the manifest.
    """
    version = uuid.uuid4().hex
    files = export(f"{path}/files-{version}")
    write_manifest(files, f"{path}/manifest-{version}")
    _put(spark, f"{path}/CURRENT", version)
    return files


def published(spark: SparkSession, path: str) -> str:
    """The manifest of the export that is published at ``path``."""
    current = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    system = current.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(current):
        raise FileNotFoundError(f"nothing is published at {path}")
    version = spark.read.format("binaryFile").load(f"{path}/CURRENT").select(F.col("content").cast("string")).first()[0]
    return f"{path}/manifest-{version}"


def load_published(spark: SparkSession, path: str, read: Callable[[list[str]], DataFrame]) -> DataFrame:
    """Read exactly the files of the export published at ``path``."""
    return load_manifest(spark, published(spark, path), read)
