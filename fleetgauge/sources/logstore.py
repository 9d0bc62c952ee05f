"""Stored logs: partitioned by day, bucketed by statement, so that reports prune days and join without a shuffle.

A log is a table of the session catalog. Its files lie in one folder per day of the log's time, and within a day in
``buckets`` files by hash of the statement's key. Two logs with the same buckets and keys join (and aggregate) on those
keys, or on more columns beside them, bucket by bucket. A report's window on the log's time opens the days of the
window only: the day column is named after the time (``rows.day_column``) and ``rows.recent`` bounds both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.rows import day_column

STATEMENT = ("cluster_id", "query")
BUCKETS = 256


def use_buckets(spark: SparkSession) -> SparkSession:
    """Let joins on more columns than the buckets' keys use the buckets as they are."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def _laid_out(df: DataFrame, ts: str | None, keys: Sequence[str], buckets: int) -> DataFrame:
    if ts is not None:
        df = df.withColumn(day_column(ts), F.col(ts).cast("date"))
    # the shuffle's partitions are the buckets: a day gets one file a bucket, written by one task
    return df.repartition(buckets, *keys)


def store_log(df: DataFrame, table: str, *, ts: str | None = None, keys: Sequence[str] = STATEMENT, buckets: int = BUCKETS,
              path: str | None = None, append: bool = False) -> DataFrame:
    """Write a log as ``table``, or add to it, and return the whole table.

    ``ts`` is the time whose days partition the log; logs without a time are only bucketed. Rows without a time go to a
    partition of their own, which no window opens. Rows are sorted within files by key and time, so that a
    statement's rows are found by the files' statistics. ``path`` places the files; else the catalog does.
    ``append`` must keep to the table's layout (Spark refuses another one); a day's load adds its files to the day.
    """
    spark = df.sparkSession
    order = [*keys, *([ts] if ts else [])]
    writer = _laid_out(df, ts, keys, buckets).write.format("parquet").mode("append" if append else "errorifexists")
    if path is not None:
        writer = writer.option("path", path)
    if ts is not None:
        writer = writer.partitionBy(day_column(ts))
    writer.bucketBy(buckets, *keys).sortBy(*order).saveAsTable(table)
    return spark.table(table)


def exchanges(df: DataFrame) -> list[str]:
    """The shuffles by key in a plan, outermost first: to see whether a report uses the layout."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    return [line.strip(" :+-*()") for line in plan.split("\n") if "Exchange hashpartitioning" in line]
