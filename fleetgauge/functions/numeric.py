"""Guarded ratios and rounding shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .temporal import as_col


def rounded(x, digits: int = 0) -> Column:
    """Half-up rounding of the scaled value: the binary value decides a tie, not its printed form."""
    scale = 10.0 ** digits
    return F.round(as_col(x) * scale) / scale


def ratio(num, den, digits: int = 6, scale: float = 1.0) -> Column:
    """``num / den * scale`` rounded; NULL when the denominator is zero or missing."""
    return rounded(F.try_divide(as_col(num).cast("double"), as_col(den).cast("double")) * scale, digits)


def percent(num, den, digits: int = 4) -> Column:
    return ratio(num, den, digits, 100.0)


def mean(c, digits: int = 4) -> Column:
    return rounded(F.avg(as_col(c)), digits)


def total_if(cond: Column, value: Column | int = 1) -> Column:
    """Sum over the rows meeting ``cond``; zero when none does."""
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))


def megabytes(c, digits: int = 4) -> Column:
    return rounded(as_col(c).cast("double") / (1024.0 * 1024.0), digits)
