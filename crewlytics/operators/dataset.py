"""Whole-row dumps with generated measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crewlytics.functions.numbers import random_between
from crewlytics.operators.ordering import ranked


def full_dataset(
    df: DataFrame, seed: int, key: str = "emp_id", limit: int | None = None
) -> DataFrame:
    """Every column plus three random measures; a limit keeps the lowest keys."""
    rows = df if limit is None else ranked(df, [key], limit, ties=[])
    row = F.col(key)
    return rows.select(
        "*",
        random_between(row, seed, 0, 1, 20, 2).alias("work_duration_years"),
        random_between(row, seed, 1, 0, 5, 1).alias("leave_duration_years"),
        random_between(row, seed, 2, 10, 100, 0).alias("performance_score"),
    )
