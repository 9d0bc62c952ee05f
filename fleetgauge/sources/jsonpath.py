"""JSON lines loaded through an ordered list of paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def json_columns(doc: str, paths: Sequence[tuple[str, str, str]]) -> list[Column]:
    """Columns from (name, path, type) triples, in order; a missing path gives NULL."""
    return [F.get_json_object(doc, path).try_cast(dtype).alias(name) for name, path, dtype in paths]


def read_json_paths(spark: SparkSession, source, paths: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Load JSON lines as the listed columns."""
    return spark.read.text(source).select(*json_columns("value", paths))
