"""Residence and duty location reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crewlytics.functions import fixed_values as fv
from crewlytics.functions.text import joined, map_code
from crewlytics.operators.distribution import PEOPLE, Dim, distribution
from crewlytics.operators.filters import staff
from crewlytics.operators.ordering import ranked
from crewlytics.sources.workforce import Workforce


def _cities_on_map(w: Workforce, source: str, code) -> DataFrame:
    """Cities with at least one counted employee; no order is promised."""
    cities = distribution(
        staff(w.personnel), [Dim("province", source)], PEOPLE, [], having=F.col("count") > 0
    )
    return cities.select(code.alias("code"), "province", "count")


def location_map_residence(w: Workforce) -> DataFrame:
    city = F.col("province")
    prefix = joined(F.lit(fv.MAP_PREFIX), F.substring(city, 1, 2))
    return _cities_on_map(w, "residence_city", map_code(city, fv.RESIDENCE_CODES, prefix))


def location_map_duty(w: Workforce) -> DataFrame:
    city = F.col("province")
    return _cities_on_map(w, "duty_city", map_code(city, fv.DUTY_CODES, city))


def _by(w: Workforce, dims: list[Dim], limit: int | None = None) -> DataFrame:
    return distribution(staff(w.personnel), dims, PEOPLE, ["-count"], limit)


def location_residence_dist(w: Workforce, limit: int | None = 100) -> DataFrame:
    return _by(w, [Dim("province", "residence_city", shown_label=fv.UNKNOWN)], limit)


def location_residence_company(w: Workforce, limit: int | None = 1000) -> DataFrame:
    places = [Dim("company"), Dim("location"), Dim("department")]
    return _by(w, [*places, Dim("province", "residence_city")], limit)


def location_duty_dist(w: Workforce) -> DataFrame:
    return _by(w, [Dim("city", "duty_city", shown_label=fv.UNKNOWN)])


def location_duty_company(w: Workforce, limit: int | None = 1000) -> DataFrame:
    places = [Dim("company"), Dim("location"), Dim("department")]
    return _by(w, [*places, Dim("city", "duty_city")], limit)


def location_employee_list(w: Workforce, limit: int | None = 5000) -> DataFrame:
    people = staff(w.personnel).select(
        "company",
        F.col("full_name").alias("name"),
        "location",
        "department",
        "position",
        "duty_city",
        "residence_city",
        "district",
    )
    return ranked(people, ["company", "name"], limit)


REPORTS = [
    location_map_residence,
    location_map_duty,
    location_residence_dist,
    location_residence_company,
    location_duty_dist,
    location_duty_company,
    location_employee_list,
]
