"""Approximate distinct counts that can be stored by day and merged, for questions over months of logs.

An exact distinct count has to see every value again for every span of days. A sketch of a day is a few kilobytes; a span is
the union of its days' sketches. Opt-in: the exact reports do not use it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: Registers of a sketch are 2 to this power.
PRECISION = 12


def relative_error(precision: int = PRECISION) -> float:
    """The relative standard error of a merged count; two thirds of all counts lie within it, nearly all within thrice of it."""
    return 1.04 / math.sqrt(2 ** precision)


def daily_sketches(log: DataFrame, value: str, ts: str, *, keys: Sequence[str] = (), precision: int = PRECISION) -> DataFrame:
    """keys, day, ``n`` (rows) and ``sketch`` of the distinct values of ``value`` on each day; NULL values do not count.

    Values are sketched before the shuffle, so a key holding a third of all rows moves one sketch a task and day.
    """
    return log.groupBy(*keys, F.col(ts).cast("date").alias("day")).agg(F.count("*").alias("n"), F.hll_sketch_agg(value, F.lit(precision)).alias("sketch"))


def merged_distinct(sketches: DataFrame, *, keys: Sequence[str] = (), start=None, end=None) -> DataFrame:
    """keys, ``n`` and ``n_distinct`` (approximate) over the days from ``start`` to ``end``, both included, from stored sketches."""
    if start is not None:
        sketches = sketches.where(F.col("day") >= F.lit(str(start)).cast("date"))
    if end is not None:
        sketches = sketches.where(F.col("day") <= F.lit(str(end)).cast("date"))
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
