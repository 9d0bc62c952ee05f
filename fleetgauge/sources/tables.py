"""Writing query results as tables: create-as-select, append, empty copies."""

from __future__ import annotations

from pyspark.sql import DataFrame


def create_table_as(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = (), sort_within: tuple[str, ...] = ()) -> DataFrame:
    """Store a result and return it read back; sorting within files sharpens later range scans."""
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def insert_into(df: DataFrame, path: str) -> DataFrame:
    """Append a result to a stored table and return the whole table."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_like(df: DataFrame) -> DataFrame:
    """The columns of a table without its rows."""
    return df.limit(0)
