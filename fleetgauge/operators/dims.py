"""Calendar dimension, date spans and small dataset helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.holidays import is_holiday
from ..functions.temporal import boundary_diff, day_name, day_of, month_name

FIRST_DAY, LAST_DAY = "1900-01-01", "2049-12-31"


def calendar_columns(days: DataFrame, *, first_years: dict[str, int] | None = None) -> DataFrame:
    """The calendar columns for a DataFrame with a ``date`` column."""
    d = F.col("date")
    return days.select(
        (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int").alias("id"), "date", F.year(d).cast("short").alias("year"),
        F.month(d).cast("short").alias("month"), F.dayofmonth(d).cast("short").alias("day"), F.quarter(d).cast("short").alias("quarter"),
        F.weekofyear(d).cast("short").alias("week"), day_name(d).alias("day_name"), month_name(d).alias("month_name"),
        is_holiday(d, first_years).alias("holiday_flag"), F.dayofweek(d).isin(1, 7).alias("weekend_flag"))


def calendar_dim(spark: SparkSession, start: str = FIRST_DAY, end: str = LAST_DAY, *, first_years: dict[str, int] | None = None) -> DataFrame:
    """One row per day from ``start`` to ``end``."""
    n = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days + 1
    days = spark.range(n).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date"))
    return calendar_columns(days, first_years=first_years)


def calendar_of(df: DataFrame, col: str, *, first_years: dict[str, int] | None = None) -> DataFrame:
    """One row per day between the first and last date of a column."""
    span = df.agg(F.min(day_of(col)).alias("lo"), F.max(day_of(col)).alias("hi"))
    return calendar_columns(span.select(F.explode(F.sequence("lo", "hi")).alias("date")), first_years=first_years)


def date_span(df: DataFrame, col: str, *, shift_from: Column | None = None) -> DataFrame:
    """First and last date, days and weeks between them, and a date shifted by that many days."""
    s = df.agg(F.min(col).alias("first"), F.max(col).alias("last"))
    days = boundary_diff("day", "first", "last")
    return s.select("first", "last", days.alias("days"), boundary_diff("week", "first", "last").alias("weeks"),
                    F.date_add(day_of(F.col("last") if shift_from is None else shift_from), days.cast("int")).alias("shifted"))


def outer_join_on(left: DataFrame, right: DataFrame, keys: list[str], *, left_only: Column | None = None, right_only: Column | None = None) -> DataFrame:
    """Left join whose extra conditions belong to the match: unmatched left rows always stay."""
    r = right if right_only is None else right.where(right_only)
    if left_only is None:
        return left.join(r, keys, "left")
    cond = left_only
    for k in keys:
        cond = cond & (left[k] == r[k])
    return left.join(r, cond, "left").drop(*[r[k] for k in keys])


def append_group_sums(df: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of a table plus one row per group holding its sum, as an insert from itself adds."""
    return df.select(key, value).unionByName(df.groupBy(key).agg(F.sum(value).alias(value)))
