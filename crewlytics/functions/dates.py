"""Date columns.  The current moment is always an argument, never the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from crewlytics.functions import fixed_values as fv


def day_of(moment: Column) -> Column:
    return F.to_date(moment)


def month_key(day: Column) -> Column:
    """The month of a date as ``yyyy-MM``."""
    return F.date_format(F.trunc(day, "MONTH"), "yyyy-MM")


def days_before(as_of: dt.date, days: int | Column) -> Column:
    return F.date_sub(F.lit(as_of), days)


def open_ended(end: Column) -> Column:
    """An interval end, with a far date standing for 'still open'."""
    return F.coalesce(end, F.lit(dt.date.fromisoformat(fv.OPEN_END)))


def covers(start: Column, end: Column, day: Column) -> Column:
    """Closed interval test; a missing end never covers anything."""
    return day.between(start, end)


def running_at(start: Column, end: Column, as_of: dt.date) -> Column:
    """Half-open test: started by ``as_of`` and not ended by it."""
    return (start <= F.lit(as_of)) & (end.isNull() | (end > F.lit(as_of)))
