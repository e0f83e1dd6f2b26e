"""Calendar periods of the search statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("day", "week", "month")


def period_key(ts: Column, period: str) -> Column:
    """First day of the period; weeks start on Sunday."""
    day = F.to_date(ts)
    if period == "day":
        return day
    if period == "week":
        return F.date_sub(day, F.dayofweek(day) - 1)
    if period == "month":
        return F.trunc(day, "month")
    raise ValueError(f"period must be one of {PERIODS}")


def week_number(day: Column) -> Column:
    """Week of the year as MySQL's %u gives it: weeks start on Monday, the first has four days or more of the year."""
    first = F.weekday(F.trunc(day, "YEAR"))
    return F.floor((F.dayofyear(day) - 1 + first) / 7) + F.when(first <= 3, 1).otherwise(0)


def period_label(ts: Column, period: str) -> Column:
    day = F.to_date(ts)
    if period == "week":
        return F.concat(F.year(day).cast("string"), F.lit(" Week "), F.lpad(week_number(day).cast("string"), 2, "0"))
    return F.date_format(day, "yyyy-MM-dd" if period == "day" else "yyyy-MM")


def inclusive_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1
