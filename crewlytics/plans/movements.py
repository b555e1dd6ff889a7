"""Hire and leave reports over the employee-month history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from crewlytics.functions import fixed_values as fv
from crewlytics.operators.filters import staff
from crewlytics.operators.kpis import period_sums, timeline
from crewlytics.operators.ordering import ranked
from crewlytics.sources.kept_sums import read_sums, renew
from crewlytics.sources.schemas import view_schema
from crewlytics.sources.scratch import shared_folder
from crewlytics.sources.workforce import Workforce

TIMELINE = "year_month string, hires bigint, leavers bigint, transfers bigint"


def _months(w: Workforce) -> DataFrame:
    return staff(w.personnel_month, active=None, regular=None)


def _flags() -> dict[str, Column]:
    return {
        "hires": F.col("is_hire") == 1,
        "leavers": F.col("is_leaver") == 1,
        "transfers": (F.col("left_unit") == 1) & (F.col("is_leaver") == 0),
    }


def turnover_timeline(w: Workforce) -> DataFrame:
    return timeline(_months(w), "year_month", _flags(), ["year_month"])


def turnover_sums(months: DataFrame) -> DataFrame:
    """The timeline's rows for some months of the history, in no order."""
    return period_sums(staff(months, active=None, regular=None), "year_month", _flags())


def renew_turnover(spark: SparkSession, history: str, path: str) -> list[str]:
    """Brings the kept timeline up to date with a stored history; returns the months' folders read."""
    return renew(spark, history, view_schema("personnel_month"), "year_month", turnover_sums, path)


def kept_turnover(spark: SparkSession, path: str) -> DataFrame:
    """The timeline from the kept sums: a row a month is read, not the history."""
    return ranked(read_sums(spark, path, StructType.fromDDL(TIMELINE)), ["year_month"], None)


def turnover_timeline_kept(w: Workforce, late: str = "199501") -> DataFrame:
    """The timeline kept up: the history stored without every third row of the months from ``late``
    on, summed, then completed and brought up to date from the folders that changed."""
    folder = shared_folder(w.spark, "turnover")
    history, sums = f"{folder}/personnel_month", f"{folder}/sums"
    rows = w.personnel_month
    held_back = (F.col("year_month") >= late) & (F.pmod(F.xxhash64("full_name"), F.lit(3)) == 0)
    for lot in (~F.coalesce(held_back, F.lit(False)), held_back):
        part = rows.where(lot).hint("rebalance", "year_month")
        part.write.mode("append").partitionBy("year_month").parquet(history)
        renew_turnover(w.spark, history, sums)
    return kept_turnover(w.spark, sums)


def turnover_details(w: Workforce, limit: int | None = 1000) -> DataFrame:
    joined = F.col("is_hire") == 1
    left = F.col("is_leaver") == 1
    moves = _months(w).where(joined | left)
    kind = F.when(joined, fv.JOINED).when(left, fv.LEFT).otherwise(fv.OTHER)
    rows = moves.select(
        F.col("year_month").alias("period"),
        "company",
        "location",
        F.col("full_name").alias("name"),
        kind.alias("movement_type"),
        "position",
        "education",
    )
    return ranked(rows, ["-period", "company"], limit)


REPORTS = [turnover_timeline, turnover_timeline_kept, turnover_details]
