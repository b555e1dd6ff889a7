"""Conditional measures: many figures from one pass over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crewlytics.operators.ordering import ranked


def sum_when(condition: Column, value: Column | int = 1) -> Column:
    """Sum over the rows that satisfy a condition, counting the others as 0.

    Over no rows at all the result is NULL, unlike a count.
    """
    return F.sum(F.when(condition, value).otherwise(0))


def count_when(condition: Column, value: Column | None = None) -> Column:
    """Number of rows that satisfy a condition (and whose value is present)."""
    return F.count(F.when(condition, F.lit(1) if value is None else value))


def count_distinct_when(condition: Column, value: Column) -> Column:
    return F.count_distinct(F.when(condition, value))


def avg_when(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


def kpi_row(df: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """One row holding every named measure."""
    return df.agg(*[measure.alias(name) for name, measure in measures.items()])


def flag_counts(conditions: Mapping[str, Column]) -> dict[str, Column]:
    """A conditional sum for every named condition."""
    return {name: sum_when(condition) for name, condition in conditions.items()}


def period_sums(df: DataFrame, period: str, conditions: Mapping[str, Column]) -> DataFrame:
    """Conditional sums per period, in no order."""
    return df.groupBy(period).agg(*[m.alias(name) for name, m in flag_counts(conditions).items()])


def timeline(
    df: DataFrame, period: str, conditions: Mapping[str, Column], order: Sequence[str]
) -> DataFrame:
    """Conditional sums per period."""
    return ranked(period_sums(df, period, conditions), order)
