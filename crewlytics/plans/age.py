"""Age reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crewlytics.functions import fixed_values as fv
from crewlytics.operators.distribution import PEOPLE, Dim, distribution
from crewlytics.operators.filters import staff
from crewlytics.operators.kpis import flag_counts, kpi_row
from crewlytics.sources.workforce import Workforce

BAND = Dim("age_group", "age_band", shown_label=fv.UNKNOWN)


def age_kpi_summary(w: Workforce) -> DataFrame:
    figures = {"avg_age": F.round(F.avg("age"), 1)}
    figures |= flag_counts({name: F.col("age_band") == b for name, b in fv.AGE_BANDS.items()})
    return kpi_row(staff(w.personnel), figures)


def _by(w: Workforce, dims: list[Dim], order: list[str], limit: int | None = None) -> DataFrame:
    return distribution(staff(w.personnel), dims, PEOPLE, order, limit)


def age_distribution(w: Workforce) -> DataFrame:
    return _by(w, [BAND], ["-count"])


def age_company_heatmap(w: Workforce) -> DataFrame:
    band = Dim("age_group", "age_band", shown_label=fv.OTHER)
    return _by(w, [Dim("company"), band], ["company", "age_group"])


def age_department_location(w: Workforce, limit: int | None = 1000) -> DataFrame:
    dims = [Dim("location"), Dim("department"), BAND]
    return _by(w, dims, ["location", "department", "-age_group"], limit)


def age_location_gender(w: Workforce, limit: int | None = 1000) -> DataFrame:
    return _by(w, [Dim("location"), Dim("gender"), BAND], ["location", "age_group"], limit)


def age_position_gender(w: Workforce, limit: int | None = 100000) -> DataFrame:
    position = Dim("position", key_label=fv.EMPTY_POSITION_DOTTED)
    return _by(w, [position, BAND, Dim("gender")], ["position", "-age_group"], limit)


REPORTS = [
    age_kpi_summary,
    age_distribution,
    age_company_heatmap,
    age_department_location,
    age_location_gender,
    age_position_gender,
]
