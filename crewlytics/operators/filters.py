"""Row filters.  All are plain predicates, so they reach the file scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from crewlytics.functions.dates import day_of


def staff(
    df: DataFrame,
    org: str | None = "1",
    active: int | None = 1,
    regular: int | None = 1,
) -> DataFrame:
    """Employees of one organisation, active and regular; ``None`` drops a condition."""
    if org is not None:
        df = df.where(F.col("org_ref") == org)
    if active is not None:
        df = df.where(F.col("is_active") == active)
    if regular is not None:
        df = df.where(F.col("is_regular") == regular)
    return df


def live(df: DataFrame, cancelled: str = "cancel_date") -> DataFrame:
    """Rows that were not cancelled."""
    return df.where(F.col(cancelled).isNull())


def after(df: DataFrame, column: str, as_of: dt.date) -> DataFrame:
    """Rows whose day is later than ``as_of``."""
    return df.where(day_of(F.col(column)) > F.lit(as_of))
