"""Marital status and children reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crewlytics.functions import fixed_values as fv
from crewlytics.operators.distribution import PEOPLE, Dim, distribution
from crewlytics.operators.filters import staff
from crewlytics.operators.kpis import flag_counts, kpi_row
from crewlytics.sources.workforce import Workforce

STATUS = Dim("status", "marital_status")


def family_kpi_summary(w: Workforce) -> DataFrame:
    figures = {"total_employees": F.count("emp_id")}
    child = F.col("child_flag")
    figures |= flag_counts({"has_children": child == "1", "no_children": child == "0"})
    return kpi_row(staff(w.personnel), figures)


def _married_or_single(w: Workforce) -> DataFrame:
    return staff(w.personnel).where(F.col("marital_status").isin(fv.MARRIED, fv.SINGLE))


def family_marital_dist(w: Workforce) -> DataFrame:
    return distribution(_married_or_single(w), [STATUS], PEOPLE, ["-count"])


def family_gender_marital(w: Workforce) -> DataFrame:
    dims = [Dim("gender"), STATUS]
    return distribution(_married_or_single(w), dims, PEOPLE, ["gender", "-count"])


def family_gender_children(w: Workforce) -> DataFrame:
    child = F.col("child_flag")
    text = F.when(child == "1", fv.HAS_CHILD).when(child == "0", fv.NO_CHILD).otherwise(fv.UNKNOWN)
    dims = [Dim("gender"), Dim("child_status", text)]
    return distribution(staff(w.personnel), dims, PEOPLE, ["-count"])


REPORTS = [family_kpi_summary, family_marital_dist, family_gender_marital, family_gender_children]
