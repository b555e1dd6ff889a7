"""Employee reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crewlytics.functions import fixed_values as fv
from crewlytics.functions.numbers import age_band, percent
from crewlytics.functions.text import known
from crewlytics.operators.distribution import HEADS, PEOPLE, Dim, distribution, distributions
from crewlytics.operators.filters import staff
from crewlytics.operators.kpis import avg_when, flag_counts, kpi_row, sum_when
from crewlytics.operators.ordering import ranked
from crewlytics.sources.workforce import Workforce

EDUCATION = Dim("education", key_label=fv.EMPTY_EDUCATION)
BIGGEST_FIRST = ["-count"]


def employees_kpi_summary(w: Workforce) -> DataFrame:
    active = F.col("is_active") == 1
    women = active & (F.col("gender") == fv.FEMALE)
    figures = flag_counts(
        {
            "total_active": active,
            "new_hires": F.col("is_hire") == 1,
            "leavers": F.col("is_leaver") == 1,
            "total_male": active & (F.col("gender") == fv.MALE),
            "total_female": women,
            "total_disabled": active & (F.col("is_disabled") == 1),
        }
    )
    figures["avg_age"] = F.round(avg_when(active, F.col("age")), 1)
    figures["female_ratio"] = percent(sum_when(women), sum_when(active), 1)
    return kpi_row(staff(w.personnel, active=None), figures)


def _by(w: Workforce, dims: list[Dim], limit: int | None = None, order=BIGGEST_FIRST) -> DataFrame:
    return distribution(staff(w.personnel), dims, PEOPLE, order, limit)


def employees_dist_position(w: Workforce, limit: int | None = 100) -> DataFrame:
    return _by(w, [Dim("position")], limit=limit)


def employees_dist_location(w: Workforce) -> DataFrame:
    return _by(w, [Dim("location")])


def employees_dist_company(w: Workforce) -> DataFrame:
    return _by(w, [Dim("company")])


def employees_dist_collar(w: Workforce) -> DataFrame:
    return _by(w, [Dim("collar_type", "staff_group", shown_label=fv.OTHER)])


def employees_dist_marital(w: Workforce) -> DataFrame:
    return _by(w, [Dim("status", "marital_status", shown_label=fv.UNKNOWN)])


def employees_dist_employment_status(w: Workforce) -> DataFrame:
    return _by(w, [Dim("status", "employment_status", shown_label=fv.OTHER)])


def employees_distributions(w: Workforce) -> DataFrame:
    """The six distributions above, all values of each, from one scan of the snapshot."""
    dims = {
        "position": Dim("position"),
        "location": Dim("location"),
        "company": Dim("company"),
        "collar_type": Dim("staff_group", shown_label=fv.OTHER),
        "marital_status": Dim("marital_status", shown_label=fv.UNKNOWN),
        "employment_status": Dim("employment_status", shown_label=fv.OTHER),
    }
    counted = distributions(staff(w.personnel), dims, PEOPLE)
    return ranked(counted, ["distribution", "-count"])


def employees_disabled(w: Workforce, limit: int | None = 1000) -> DataFrame:
    names = ["location", "department", "position", "disability_degree", "gender"]
    disabled = staff(w.personnel).where(F.col("is_disabled") == 1)
    return distribution(disabled, [Dim(n) for n in names], PEOPLE, BIGGEST_FIRST, limit)


def employees_duty_place(w: Workforce, limit: int | None = 1000) -> DataFrame:
    return _by(w, [Dim("duty_place", key_label=fv.NO_DUTY_PLACE)], limit=limit)


def employees_company_position(w: Workforce, limit: int | None = 1000) -> DataFrame:
    position = Dim("position", key_label=fv.NO_POSITION)
    return _by(w, [Dim("company"), Dim("location"), position], limit=limit)


def employees_demographics_basic(w: Workforce, limit: int | None = 1000) -> DataFrame:
    dims = [Dim("company"), Dim("location"), EDUCATION, Dim("gender")]
    return _by(w, dims, limit=limit, order=["company", "-education"])


def employees_demographics_full(w: Workforce, limit: int | None = 1000) -> DataFrame:
    position = Dim("position", key_label=fv.EMPTY_POSITION)
    dims = [Dim("company"), Dim("location"), position, Dim("gender"), EDUCATION]
    return _by(w, dims, limit=limit)


def employees_department_stats(w: Workforce, limit: int | None = 15) -> DataFrame:
    everyone = staff(w.personnel, org=None, regular=None)
    return distribution(everyone, [Dim("category", "department")], HEADS, ["-value"], limit)


def employees_age_stats(w: Workforce) -> DataFrame:
    everyone = staff(w.personnel, org=None, regular=None)
    band = Dim("category", age_band(F.col("age_band"), F.col("age")))
    return distribution(everyone, [band], HEADS, ["category"])


def employees_city_stats(w: Workforce, limit: int | None = 10) -> DataFrame:
    everyone = staff(w.personnel, org=None, regular=None)
    answered = everyone.where(known(F.col("residence_city"), fv.PLACEHOLDER))
    city = Dim("category", "residence_city", shown_label=fv.UNKNOWN)
    return distribution(answered, [city], HEADS, ["-value"], limit)


REPORTS = [
    employees_kpi_summary,
    employees_dist_position,
    employees_dist_location,
    employees_dist_company,
    employees_dist_collar,
    employees_dist_marital,
    employees_dist_employment_status,
    employees_distributions,
    employees_disabled,
    employees_duty_place,
    employees_company_position,
    employees_demographics_basic,
    employees_demographics_full,
    employees_department_stats,
    employees_age_stats,
    employees_city_stats,
]
