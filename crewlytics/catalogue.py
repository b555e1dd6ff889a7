"""Every registered query by name, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crewlytics.plans import (
    age,
    blood,
    checks,
    datasets,
    education,
    employees,
    engagement,
    family,
    interns,
    location,
    movements,
    tables,
    training,
)
from crewlytics.sources.workforce import Workforce
from crewlytics.twins import checks as check_twins
from crewlytics.twins import people as people_twins
from crewlytics.twins import training as training_twins

FAMILIES = [
    employees,
    education,
    age,
    blood,
    location,
    engagement,
    movements,
    family,
    interns,
    training,
    datasets,
    checks,
    tables,
]


def reports() -> dict[str, Callable[[Workforce], DataFrame]]:
    return {report.__name__: report for module in FAMILIES for report in module.REPORTS}


def directory_reports() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries that read a directory themselves, such as streams."""
    return {report.__name__: report for report in checks.DIRECTORY_REPORTS}


def twins() -> dict[str, str]:
    return people_twins.TWINS | training_twins.TWINS | check_twins.TWINS
