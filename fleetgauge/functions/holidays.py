"""United States federal holidays as column rules, with the year each rule starts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Holidays on a date, observed on Friday or Monday when they fall on a weekend.
FIXED_DATE = [
    # name, month, day, first year
    ("New Year's Day", 1, 1, 1900),
    ("Juneteenth", 6, 19, 2021),
    ("Independence Day", 7, 4, 1900),
    ("Veterans Day", 11, 11, 1900),
    ("Christmas Day", 12, 25, 1900),
]
# Holidays on the n-th given weekday of a month (0 = Sunday); -1 is the last one.
NTH_WEEKDAY = [
    # name, month, weekday, n, first year
    ("Martin Luther King Jr. Day", 1, 1, 3, 1986),
    ("Presidents Day", 2, 1, 3, 1900),
    ("Memorial Day", 5, 1, -1, 1900),
    ("Labor Day", 9, 1, 1, 1900),
    ("Columbus Day", 10, 1, 2, 1900),
    ("Thanksgiving", 11, 4, 4, 1900),
]


def is_holiday(d: Column, first_years: dict[str, int] | None = None) -> Column:
    """Whether ``d`` is an observed federal holiday. ``first_years`` overrides rule start years."""
    first_years = first_years or {}
    weekday = F.dayofweek(d) - 1
    hit = F.lit(False)
    for name, month, day, first in FIXED_DATE:
        first = first_years.get(name, first)
        # the holiday itself on a working day, or the working day next to a weekend holiday
        for shift, days in ((0, (1, 2, 3, 4, 5)), (1, (5,)), (-1, (1,))):
            actual = F.date_add(d, shift)
            hit = hit | (
                (F.month(actual) == month) & (F.dayofmonth(actual) == day)
                & (F.year(actual) >= first) & weekday.isin(*days)
            )
    for name, month, on, n, first in NTH_WEEKDAY:
        first = first_years.get(name, first)
        if n > 0:
            place = F.dayofmonth(d).between(7 * n - 6, 7 * n)
        else:
            place = F.month(F.date_add(d, 7)) != month
        hit = hit | ((F.month(d) == month) & (weekday == on) & place & (F.year(d) >= first))
    return hit
