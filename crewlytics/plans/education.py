"""Education reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crewlytics.functions import fixed_values as fv
from crewlytics.functions.text import missing
from crewlytics.operators.distribution import PEOPLE, Dim, distribution
from crewlytics.operators.filters import staff
from crewlytics.operators.kpis import flag_counts, kpi_row
from crewlytics.sources.workforce import Workforce

EDUCATION = Dim("education", key_label=fv.EMPTY_EDUCATION)


def education_kpi_summary(w: Workforce) -> DataFrame:
    level = F.col("education")
    figures = {"total_employees": F.count("emp_id")}
    figures |= flag_counts({name: level == text for name, text in fv.EDUCATION_LEVELS.items()})
    figures |= flag_counts({"no_info": missing(level, fv.PLACEHOLDER)})
    return kpi_row(staff(w.personnel), figures)


def _by(w: Workforce, dims: list[Dim], order: list[str], limit: int | None = None) -> DataFrame:
    return distribution(staff(w.personnel), dims, PEOPLE, order, limit)


def education_age_heatmap(w: Workforce) -> DataFrame:
    level = Dim("education", key_label=fv.UNKNOWN)
    band = Dim("age_group", "age_band", key_label=fv.OTHER)
    return _by(w, [level, band], ["education", "-age_group"])


def education_level_dist(w: Workforce) -> DataFrame:
    measures = PEOPLE | {"level_code": "min(education_level)"}
    return distribution(staff(w.personnel), [EDUCATION], measures, ["-count"])


def education_gender_dist(w: Workforce) -> DataFrame:
    return _by(w, [EDUCATION, Dim("gender")], ["-count"])


def education_location_gender(w: Workforce, limit: int | None = 1000) -> DataFrame:
    dims = [Dim("company"), Dim("location"), EDUCATION, Dim("gender")]
    return _by(w, dims, ["location"], limit)


def education_department(w: Workforce, limit: int | None = 1000) -> DataFrame:
    dims = [Dim("company"), Dim("location"), Dim("department"), EDUCATION, Dim("gender")]
    return _by(w, dims, ["company", "-location"], limit)


def education_position_location(w: Workforce, limit: int | None = 1000) -> DataFrame:
    dims = [Dim("company"), Dim("location"), Dim("position"), EDUCATION, Dim("gender")]
    return _by(w, dims, ["position", "-gender"], limit)


def education_position(w: Workforce, limit: int | None = 1000) -> DataFrame:
    position = Dim("position", key_label=fv.EMPTY_POSITION_DOTTED)
    return _by(w, [position, EDUCATION, Dim("gender")], ["position", "-gender"], limit)


REPORTS = [
    education_kpi_summary,
    education_age_heatmap,
    education_level_dist,
    education_gender_dist,
    education_location_gender,
    education_department,
    education_position_location,
    education_position,
]
