"""Table scans and the catalog of a dataset's columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.rows import recent


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored table, reading only the named columns."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def time_bounded_scan(spark: SparkSession, path: str, ts: str, *, as_of, lookback_days: float, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of a stored log from the last days; the bound is pushed into the file scan."""
    return recent(scan(spark, path, columns), ts, as_of, lookback_days)


def column_catalog(df: DataFrame, table: str) -> DataFrame:
    """Columns of a dataset with type, declared order and how many values are present."""
    counts = df.agg(F.count("*").alias("__rows"), *[F.count(c).alias(c) for c in df.columns])
    entries = [F.struct(F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(n).alias("ordinal"),
                        F.lit(f.dataType.simpleString()).alias("data_type"), F.col("__rows").alias("rows"), F.col(f.name).alias("present"))
               for n, f in enumerate(df.schema.fields, 1)]
    return counts.select(F.inline(F.array(*entries)))


def registered_columns(spark: SparkSession, table: str) -> DataFrame:
    """Columns of a table known to the session catalog."""
    rows = [(table, c.name, n, c.dataType, c.nullable) for n, c in enumerate(spark.catalog.listColumns(table), 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, data_type string, nullable boolean")
