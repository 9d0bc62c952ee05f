"""Row-level conventions shared by the report operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.temporal import as_col, at, within

SYSTEM_USER_MAX = 1


def user_rows(df: DataFrame, col: str = "userid", system_user_max: int | None = SYSTEM_USER_MAX) -> DataFrame:
    """Hide the system users; ``None`` keeps every row."""
    return df if system_user_max is None else df.where(F.col(col) > system_user_max)


def day_column(ts: str) -> str:
    """The column by which a stored log is partitioned: the day of its time ``ts``."""
    return f"{ts}__day"


def _edge(as_of, lookback_days: float) -> dt.datetime:
    return dt.datetime.fromisoformat(str(as_of)) - dt.timedelta(days=lookback_days)


def recent(df: DataFrame, ts: str, as_of, lookback_days: float | None) -> DataFrame:
    """Time-bounded scan: a comparison of the raw column, so it reaches the file scan.

    Of a log that is stored by day of ``ts``, only the days of the window are opened.
    """
    if as_of is None and lookback_days is None:
        return df
    bound = within(ts, as_of, lookback_days)
    day = day_column(ts)
    if day in df.columns:
        bound = bound & (F.col(day) <= F.lit(dt.datetime.fromisoformat(str(as_of)).date()))
        if lookback_days is not None:
            bound = bound & (F.col(day) >= F.lit(_edge(as_of, lookback_days).date()))
    return df.where(bound)


def since(df: DataFrame, ts: str, as_of, lookback_days: float | None) -> DataFrame:
    """Rows not before the window of ``recent``: for what is logged when a statement of the window ends."""
    if as_of is None or lookback_days is None:
        return df
    edge, day = _edge(as_of, lookback_days), day_column(ts)
    bound = F.col(ts) >= at(edge.isoformat(sep=" "))
    return df.where(bound & (F.col(day) >= F.lit(edge.date())) if day in df.columns else bound)


def told_of(log: DataFrame, bounded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of an unbounded log about the statements (or transactions) of a bounded one."""
    return log.join(bounded.select(*keys), list(keys), "left_semi")


def only(df: DataFrame, **equals) -> DataFrame:
    """Optional equality or membership filters; a ``None`` value filters nothing."""
    for col, value in equals.items():
        if value is None:
            continue
        values = value if isinstance(value, (list, tuple, set)) else [value]
        df = df.where(F.col(col).isin(*values))
    return df


def between(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(str(end)).cast("timestamp_ntz"))
    return df


def top(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """Sort only when a limit is asked for, so it runs as a top-N without a global sort."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def cut(text, chars: int | None) -> Column:
    """Optional display cut of a statement text; the whole text by default."""
    return as_col(text) if chars is None else F.substring(as_col(text), 1, chars)


def catalog_keys(fleet: Sequence[str], *frames: DataFrame) -> list[str]:
    """Keys to join catalog tables on: the fleet's, or for logs of one cluster the catalog's own cluster key."""
    return list(fleet) or [c for c in ("cluster_id",) if all(c in f.columns for f in frames)]


def newest(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Newest row per key, combined before the shuffle instead of ranked after it."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(F.col(ts), F.xxhash64(*rest))).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*")
