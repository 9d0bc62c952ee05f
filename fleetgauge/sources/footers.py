"""Layout of stored Parquet tables from their footers: row groups, column bytes, encodings, smallest and largest values.

Footers are read by the executors, a few kilobytes a file; no data page is touched. The reports over them say for a
table of one's own what the layout reports say for a warehouse's tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import rounded
from .listing import listed, opened

_FOOTERS = ("folder string, url string, row_group int, rows bigint, column string, n_values bigint, n_nulls bigint, stored_bytes bigint, "
            "plain_bytes bigint, encodings string, compression string, low string, high string, low_number double, high_number double")


def _number(v) -> float | None:
    """Numbers and times as a double, times in microseconds since 1970; nothing for texts."""
    if isinstance(v, dt.datetime):
        v = (v.replace(tzinfo=None) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    elif isinstance(v, dt.date):
        v = (v - dt.date(1970, 1, 1)).days * 86_400_000_000
    return float(v) if isinstance(v, (int, float)) else None


def _chunks(folder: str, url: str) -> Iterator[tuple]:
    system, path = opened(url)
    with system.open_input_file(path) as file:
        footer = pq.ParquetFile(file).metadata
    for g in range(footer.num_row_groups):
        group = footer.row_group(g)
        for c in range(group.num_columns):
            chunk = group.column(c)
            stats = chunk.statistics if chunk.is_stats_set else None
            bounds = (stats.min, stats.max) if stats is not None and stats.has_min_max else (None, None)
            nulls = stats.null_count if stats is not None and stats.has_null_count else None
            yield (folder, url, g, group.num_rows, chunk.path_in_schema, chunk.num_values, nulls, chunk.total_compressed_size, chunk.total_uncompressed_size,
                   ",".join(sorted(set(chunk.encodings))), chunk.compression, *[None if b is None else str(b) for b in bounds], *map(_number, bounds))


def parquet_footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per file, row group and column of the Parquet files at ``paths``.

    ``n_values`` counts entries with NULLs (of a list, its elements); ``n_nulls``, ``low`` and ``high`` are NULL where
    the writer left them out. Texts' bounds may be cut short by the writer. Files are dealt over all tasks by name.
    """
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 4, *[pa.string()] * 4, *[pa.float64()] * 2]
    names = [c.split()[0] for c in _FOOTERS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(_chunks(folder, url))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = listed(spark.createDataFrame([(p,) for p in paths], "folder string"))
    return files.where(F.col("name").rlike("[.]parquet$")).select("folder", "url").repartition("url").mapInArrow(read, _FOOTERS)


def column_cost(footers: DataFrame) -> DataFrame:
    """Bytes, values and bytes per value of each column, its compression and the share of the table it takes."""
    per = footers.groupBy("folder", "column").agg(
        F.sum("stored_bytes").alias("stored_bytes"), F.sum("plain_bytes").alias("plain_bytes"), F.sum("n_values").alias("n_values"),
        F.sum("n_nulls").alias("n_nulls"), F.min("low_number").alias("low"), F.max("high_number").alias("high"))
    whole = per.groupBy("folder").agg(F.sum("stored_bytes").alias("__all"))
    return per.join(whole, "folder").select(
        "folder", "column", "stored_bytes", "n_values", "n_nulls", "low", "high", rounded(F.try_divide("stored_bytes", "n_values"), 4).alias("bytes_per_value"),
        rounded(F.try_divide("plain_bytes", "stored_bytes"), 4).alias("compression_ratio"), rounded(F.col("stored_bytes") * 100.0 / F.col("__all"), 4).alias("pct_of_table"))


def file_skew(footers: DataFrame) -> DataFrame:
    """Files, row groups and how unevenly rows and bytes lie over the files of each table."""
    groups = footers.groupBy("folder", "url", "row_group").agg(F.max("rows").alias("rows"), F.sum("stored_bytes").alias("bytes"))
    per = groups.groupBy("folder", "url").agg(F.count("*").alias("groups"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    return per.groupBy("folder").agg(
        F.count("*").alias("files"), F.sum("groups").alias("row_groups"), F.sum("rows").alias("rows"), F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows"),
        rounded(F.try_divide(F.max("rows").cast("double"), F.min("rows")), 4).alias("rows_skew"),
        rounded(F.try_divide(F.max("bytes").cast("double"), F.min("bytes")), 4).alias("bytes_skew"))


def groups_to_read(footers: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """How many row groups a range condition on a column has to read: what a scan with that filter cannot skip.

    ``low`` and ``high`` are numbers (times: microseconds since 1970). Groups without bounds count as read. A column that the
    table is sorted by needs about the range's share of the groups, an unsorted one all of them.
    """
    of = footers.where(F.col("column") == column)
    skipped = F.lit(False)
    if low is not None:
        skipped = skipped | F.coalesce(F.col("high_number") < F.lit(float(low)), F.lit(False))
    if high is not None:
        skipped = skipped | F.coalesce(F.col("low_number") > F.lit(float(high)), F.lit(False))
    read = ~skipped
    return of.groupBy("folder").agg(
        F.count("*").alias("row_groups"), F.count_if(read).alias("read_groups"), F.sum("rows").alias("rows"),
        F.coalesce(F.sum(F.when(read, F.col("rows"))), F.lit(0)).alias("read_rows"), F.coalesce(F.sum(F.when(read, F.col("stored_bytes"))), F.lit(0)).alias("read_bytes"))
