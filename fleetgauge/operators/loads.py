"""File load, transfer and export reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import rounded
from ..functions.temporal import US, boundary_diff, epoch_us, int_div
from ..functions.text import trimmed
from .ordered import neighbour
from .rows import cut, only, recent, told_of, top

MB = 1048576
MINUTE_US = US["minute"]


def load_performance(filelog: DataFrame, querylog: DataFrame, *, as_of=None, lookback: float | None = None,
                     limit: int | None = None, text_chars: int | None = None, fleet: Sequence[str] = ()) -> DataFrame:
    """Files, whole megabytes, seconds and megabytes per second of each load, slowest first.

    The window holds loads whose last file ended in it, with all their files: both bounds reach the scan that finds
    those loads, and only their files are summed.
    """
    load = [*fleet, "query"]
    files = filelog.where((F.col("http_method") == "GET") & (F.col("query") > 0) & (F.col("transfer_time") > 0))
    if as_of is not None:
        upto = dt.datetime.fromisoformat(str(as_of)).replace(tzinfo=dt.timezone.utc)
        us = lambda t: (t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
        files = files.where(F.col("end_time") <= us(upto))
        if lookback is not None:
            files = told_of(files, files.where(F.col("end_time") >= us(upto - dt.timedelta(days=lookback))), load)
    elif lookback is not None:
        raise ValueError("a lookback needs as_of")
    files = files.groupBy(*load).agg(
        F.count("*").alias("n_files"), F.sum(int_div("transfer_size", MB)).alias("size_mb"),
        int_div(F.max("end_time") - F.min("start_time"), US["second"]).alias("seconds"))
    q = querylog.select(*load, "starttime", cut("querytxt", text_chars).alias("querytxt"))
    out = files.join(q, load, "left").select(
        *fleet, "starttime", "query", "querytxt", "n_files", "size_mb", "seconds",
        int_div("size_mb", F.greatest("seconds", F.lit(1))).alias("mb_per_s"))
    return top(out, limit, F.desc("seconds"), F.desc("size_mb"), "query")


def load_by_node(filelog: DataFrame, slices: DataFrame, *, query=None, fleet: Sequence[str] = ()) -> DataFrame:
    """Volume, rate, mean minutes per transfer phase and retries of each node."""
    phases = ("transfer", "compression", "app_connect", "connect")
    per_slice = only(filelog, query=query).groupBy(*fleet, "slice").agg(
        F.sum("data_size").alias("data"), F.sum("transfer_size").alias("moved"), F.sum("retries").alias("retries"), F.count("*").alias("n"),
        *[F.sum(f"{p}_time").alias(p) for p in phases])
    s = per_slice.join(slices, [*fleet, "slice"]).groupBy(*fleet, "node").agg(*[F.sum(c).alias(c) for c in ("data", "moved", "retries", "n", *phases)])
    mean_us = lambda p: F.col(p) / F.col("n")
    return s.select(
        *fleet, "node", rounded(F.col("data") / float(MB), 2).alias("raw_mb"), rounded(F.col("moved") / float(MB), 2).alias("transferred_mb"),
        rounded(F.try_divide(F.col("moved") / float(MB), mean_us("transfer") / 1e6), 2).alias("mb_per_s"),
        *[rounded(mean_us(p) / 60e6, 4).alias(f"{p}_min") for p in phases], "retries")


def bucket_label(value: Column, edges: Sequence[int]) -> Column:
    """Label of the half-open bucket a value falls in: edges (2, 6) give 0_1, 2_5 and 6_plus."""
    lows = [0, *edges]
    out = F.when(F.lit(False), "")
    for low, high in zip(lows, edges):
        out = out.when(value < high, f"{low}_{high - 1}")
    return out.otherwise(f"{lows[-1]}_plus")


def transfer_histogram(filelog: DataFrame, *, edges: Sequence[int] = (2, 6), query=None, fleet: Sequence[str] = ()) -> DataFrame:
    """Files by transfer time in whole minutes."""
    return only(filelog, query=query).groupBy(
        *fleet, bucket_label(F.col("transfer_time") / MINUTE_US, edges).alias("minutes")).agg(F.count("*").alias("n"))


def node_transfer_histogram(filelog: DataFrame, slices: DataFrame, *, edges: Sequence[int] = (2, 4, 5, 7, 9, 11), query=None,
                            fleet: Sequence[str] = ()) -> DataFrame:
    """Nodes by their mean transfer minutes."""
    return load_by_node(filelog, slices, query=query, fleet=fleet).groupBy(*fleet, bucket_label(F.col("transfer_min"), edges).alias("minutes")).agg(F.count("*").alias("n"))


def file_gap_by_node(loadcommits: DataFrame, slices: DataFrame, *, as_of=None, lookback: float | None = None,
                     fleet: Sequence[str] = ()) -> DataFrame:
    """Longest wait between consecutive files of a load, and files, per node."""
    files = recent(loadcommits, "curtime", as_of, lookback).select(*fleet, "query", "slice", "curtime", "filename")
    prev = neighbour(files, [*fleet, "query"], ["curtime", "filename", "slice"], int_div(epoch_us("curtime"), US["day"]), {"prev_time": "curtime"})
    per_slice = prev.groupBy(*fleet, "slice").agg(F.max(boundary_diff("second", "prev_time", "curtime")).alias("gap"), F.count("*").alias("n"))
    return per_slice.join(slices, [*fleet, "slice"]).groupBy(*fleet, "node").agg(F.max("gap").alias("max_gap_s"), F.sum("n").alias("files"))


def load_status(loadstate: DataFrame, *, pid=None) -> DataFrame:
    """Loads in progress."""
    return only(loadstate, pid=pid)


def load_errors(loaderrors: DataFrame, classes: DataFrame, *, fleet: Sequence[str] = ()) -> DataFrame:
    """Rejected values with table, file, line, column and reason, each once."""
    names = classes.select(*fleet, F.col("oid").alias("tbl"), trimmed("relname").alias("table_name"))
    return loaderrors.join(names, [*fleet, "tbl"]).select(
        *fleet, "table_name", "query", trimmed("filename").alias("filename"), "line_number", trimmed("colname").alias("colname"),
        trimmed("raw_field_value").alias("raw_field_value"), trimmed("err_reason").alias("err_reason")).distinct()


def last_load_errors(loaderrors: DataFrame, *, query=None, userid=None, fleet: Sequence[str] = ()) -> DataFrame:
    """Errors of one load: the given one, or the latest (of a user) in each cluster."""
    mine = only(loaderrors, userid=userid, query=query)
    if query is None and fleet:
        mine = told_of(mine, mine.groupBy(*fleet).agg(F.max("query").alias("query")), [*fleet, "query"])
    elif query is None:
        mine = mine.where(F.col("query") == mine.select(F.max("query")).scalar())
    return mine.select(
        *fleet, "query", "starttime", "filename", "line_number", "err_reason", "colname", F.col("type").alias("column_type"), "col_length", "raw_field_value")


def export_layout(blocks: DataFrame, tableinfo: DataFrame, *, table_id=None, fleet: Sequence[str] = ()) -> DataFrame:
    """Blocks and values per slice, next to the table's size: how even its export files will be."""
    per = only(blocks, tbl=table_id).groupBy(*fleet, "tbl", "slice").agg(F.count("*").alias("blocks"), F.sum("num_values").alias("values"))
    t = tableinfo.select(*fleet, F.col("table_id").alias("tbl"), "table_name", "size")
    return per.join(t, [*fleet, "tbl"]).select(*fleet, "tbl", "table_name", "slice", "blocks", "values", "size")


def layout_profile(df: DataFrame, bucket: Column, *, name: str = "bucket") -> DataFrame:
    """How evenly any dataset spreads over a bucketing expression (file, partition column, hash)."""
    per = df.groupBy(bucket.alias(name)).agg(F.count("*").alias("rows"))
    # one subquery for the three totals
    s = per.agg(F.struct(F.sum("rows").alias("t"), F.max("rows").alias("hi"), F.min("rows").alias("lo")).alias("s")).scalar()
    return per.select(name, "rows", rounded(F.col("rows") * 100.0 / s["t"], 4).alias("pct"), rounded(s["hi"] / s["lo"], 4).alias("skew"))


def file_sizes(df: DataFrame) -> DataFrame:
    """Rows per source file of a dataset read from storage."""
    return layout_profile(df, F.input_file_name(), name="file")
