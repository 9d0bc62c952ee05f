"""Tables in and out: given inputs, and intermediates written to the folder all executors share."""

from __future__ import annotations

import os
import zipfile

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ..session import configure, shared_dir

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(spark: SparkSession) -> SparkSession:
    """The configured session, with this package's modules sent to the executors as ``--py-files`` would."""
    context = spark.sparkContext
    if not any(os.path.basename(f) == "fleetgauge.zip" for f in context._python_includes):
        archive = os.path.join(SparkFiles.getRootDirectory(), "package", "fleetgauge.zip")
        os.makedirs(os.path.dirname(archive), exist_ok=True)
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(_PACKAGE):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
        context.addPyFile(archive)
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refuse(df: DataFrame, *names: str) -> None:
    """Raise if ``df`` has a column that an operator adds: it would be overwritten."""
    taken = sorted({c.lower() for c in df.columns} & {n.lower() for n in names})
    if taken:
        raise ValueError(f"the operator adds columns of these names: {', '.join(taken)}")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once and read back: later steps neither recompute it nor see other row ids.

    A lost executor costs only its running tasks, since the files lie in ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{purpose}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
