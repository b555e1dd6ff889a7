"""Blood group reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crewlytics.functions import fixed_values as fv
from crewlytics.functions.text import known, missing
from crewlytics.operators.distribution import PEOPLE, Dim, distribution
from crewlytics.operators.filters import staff
from crewlytics.operators.kpis import flag_counts, kpi_row
from crewlytics.sources.workforce import Workforce

GROUP = Dim("blood_type", shown_label=fv.UNKNOWN)


def blood_kpi_summary(w: Workforce) -> DataFrame:
    group = F.col("blood_type")
    figures = {"total": F.count("emp_id")}
    figures |= flag_counts({name: group == text for name, text in fv.BLOOD_GROUPS.items()})
    figures |= flag_counts({"unknown": missing(group, fv.PLACEHOLDER)})
    return kpi_row(staff(w.personnel), figures)


def blood_distribution(w: Workforce) -> DataFrame:
    return distribution(staff(w.personnel), [GROUP], PEOPLE, ["-count"])


def blood_gender_dist(w: Workforce) -> DataFrame:
    return distribution(staff(w.personnel), [Dim("gender")], PEOPLE, ["-count"])


def blood_age_dist(w: Workforce) -> DataFrame:
    answered = staff(w.personnel).where(known(F.col("blood_type"), fv.PLACEHOLDER, trim=True))
    dims = [Dim("blood_type"), Dim("age_group", "age_band", key_label=fv.UNKNOWN)]
    return distribution(answered, dims, PEOPLE, ["blood_type", "age_group"])


def blood_company_heatmap(w: Workforce) -> DataFrame:
    dims = [Dim("company"), Dim("blood_type", key_label=fv.UNKNOWN)]
    return distribution(staff(w.personnel), dims, PEOPLE, ["company", "-count"])


def blood_table_details(w: Workforce, limit: int | None = 1000) -> DataFrame:
    dims = [Dim("company"), Dim("location"), GROUP, Dim("gender")]
    return distribution(staff(w.personnel), dims, PEOPLE, ["-count"], limit)


REPORTS = [
    blood_kpi_summary,
    blood_distribution,
    blood_gender_dist,
    blood_age_dist,
    blood_company_heatmap,
    blood_table_details,
]
