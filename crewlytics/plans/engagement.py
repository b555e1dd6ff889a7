"""Tenure and leave duration reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crewlytics.functions.numbers import mean_or_zero
from crewlytics.operators.distribution import Dim, distribution
from crewlytics.operators.filters import staff
from crewlytics.operators.kpis import kpi_row
from crewlytics.operators.ordering import ranked
from crewlytics.sources.workforce import Workforce

DURATIONS = ["work_duration", "leave_duration"]


def _rows(w: Workforce) -> DataFrame:
    return staff(w.engagement, active=None, regular=None)


def _averages() -> dict[str, Column]:
    return {f"avg_{name}": mean_or_zero(F.col(name)) for name in DURATIONS}


def engagement_kpi_summary(w: Workforce) -> DataFrame:
    return kpi_row(_rows(w), _averages())


def _by(w: Workforce, dim: Dim, limit: int | None = None) -> DataFrame:
    return distribution(_rows(w), [dim], _averages(), ["-avg_work_duration"], limit)


def engagement_by_location(w: Workforce, limit: int | None = 100) -> DataFrame:
    return _by(w, Dim("location"), limit)


def engagement_by_department(w: Workforce, limit: int | None = 100) -> DataFrame:
    return _by(w, Dim("department"), limit)


def engagement_by_marital(w: Workforce) -> DataFrame:
    return _by(w, Dim("status", "marital_status"))


def engagement_by_age_group(w: Workforce) -> DataFrame:
    return _by(w, Dim("age_group", "age_band"))


def engagement_by_education(w: Workforce) -> DataFrame:
    return _by(w, Dim("education"))


def engagement_details(w: Workforce, limit: int | None = 5000) -> DataFrame:
    people = _rows(w).select(
        "company",
        "location",
        "dept_code",
        F.col("full_name").alias("name"),
        "position",
        "gender",
        "age",
        F.col("marital_status").alias("status"),
        "education",
        "work_duration",
        "leave_duration",
    )
    return ranked(people, ["-work_duration"], limit)


REPORTS = [
    engagement_kpi_summary,
    engagement_by_location,
    engagement_by_department,
    engagement_by_marital,
    engagement_by_age_group,
    engagement_by_education,
    engagement_details,
]
