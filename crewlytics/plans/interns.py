"""Intern and apprentice reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crewlytics.functions import fixed_values as fv
from crewlytics.operators.distribution import PEOPLE, Dim, distribution
from crewlytics.operators.filters import staff
from crewlytics.operators.kpis import flag_counts, kpi_row
from crewlytics.sources.workforce import Workforce


def _students(w: Workforce) -> DataFrame:
    kinds = F.col("staff_type").isin(fv.INTERN, fv.APPRENTICE)
    return staff(w.personnel, regular=None).where(kinds)


def intern_kpi_summary(w: Workforce) -> DataFrame:
    kind = F.col("staff_type")
    figures = flag_counts(
        {"intern_count": kind == fv.INTERN, "apprentice_count": kind == fv.APPRENTICE}
    )
    figures["total_students"] = F.count("emp_id")
    return kpi_row(_students(w), figures)


def intern_details(w: Workforce, limit: int | None = 1000) -> DataFrame:
    dims = [
        Dim("location"),
        Dim("department"),
        Dim("type", "staff_type"),
        Dim("gender"),
        Dim("blood_type", shown_label=fv.DASH),
        Dim("age_group", "age_band"),
        Dim("education", shown_label=fv.DASH),
    ]
    return distribution(_students(w), dims, PEOPLE, ["-count"], limit)


REPORTS = [intern_kpi_summary, intern_details]
