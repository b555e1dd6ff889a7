"""The timeline kept up month by month against the one made from the whole history."""

from __future__ import annotations

import os
import shutil

import pytest
from frames import rows_of

from crewlytics.plans.movements import kept_turnover, renew_turnover, turnover_timeline
from crewlytics.sources.schemas import view_schema
from crewlytics.sources.workforce import Workforce, write_views


def full(spark, history):
    months = spark.read.schema(view_schema("personnel_month")).parquet(history)
    return rows_of(turnover_timeline(Workforce(spark, lambda name: months)))


@pytest.fixture
def kept(spark, workforce, tmp_path):
    write_views(workforce, str(tmp_path), ["personnel_month"])
    return str(tmp_path / "personnel_month"), str(tmp_path / "sums")


def renewed(spark, kept):
    history, sums = kept
    read = renew_turnover(spark, history, sums)
    assert rows_of(kept_turnover(spark, sums)) == full(spark, history)
    return read


def test_only_changed_months_are_read(spark, kept):
    history, sums = kept
    months = sorted(n for n in os.listdir(history) if n.startswith("year_month="))
    assert renewed(spark, kept) == months
    assert renewed(spark, kept) == []
    moved = spark.read.schema(view_schema("personnel_month")).parquet(history).where("year_month = '199805'")
    others = {n: os.listdir(f"{sums}/{n}") for n in months if n != "year_month=199805"}
    moved.write.mode("append").partitionBy("year_month").parquet(history)
    assert renewed(spark, kept) == ["year_month=199805"]
    assert {n: os.listdir(f"{sums}/{n}") for n in others} == others


def test_months_that_go_or_come_back(spark, kept, tmp_path):
    history, sums = kept
    renewed(spark, kept)
    shutil.move(f"{history}/year_month=199805", str(tmp_path / "aside"))
    assert renewed(spark, kept) == []
    assert not os.path.exists(f"{sums}/year_month=199805")
    shutil.move(str(tmp_path / "aside"), f"{history}/year_month=199805")
    assert renewed(spark, kept) == ["year_month=199805"]


def test_a_lost_month_of_sums_is_made_good(spark, kept):
    renewed(spark, kept)
    shutil.rmtree(f"{kept[1]}/year_month=199706")
    assert renewed(spark, kept) == ["year_month=199706"]


def test_months_without_value_or_out_of_scope(spark, make, tmp_path):
    rows = [
        {"year_month": None, "org_ref": "1", "is_hire": 1, "is_leaver": 0, "left_unit": 1},
        {"year_month": None, "org_ref": "1", "is_hire": None, "is_leaver": None, "left_unit": None},
        {"year_month": "202401", "org_ref": "2", "is_hire": 1, "is_leaver": 0, "left_unit": 0},
        {"year_month": "202402", "org_ref": "1", "is_hire": 1, "is_leaver": 1, "left_unit": 1},
        {"year_month": "20/24%", "org_ref": "1", "is_hire": 0, "is_leaver": 1, "left_unit": 1},
    ]
    kept = str(tmp_path / "history"), str(tmp_path / "sums")
    make("personnel_month", rows).write.partitionBy("year_month").parquet(kept[0])
    assert len(renewed(spark, kept)) == 4
    assert renewed(spark, kept) == []
    assert rows_of(kept_turnover(spark, kept[1])) == sorted(
        [(None, 1, 0, 1), ("20/24%", 0, 1, 0), ("202402", 1, 1, 0)], key=repr
    )


def test_an_empty_history(spark, make, tmp_path):
    kept = str(tmp_path / "history"), str(tmp_path / "sums")
    make("personnel_month", []).write.parquet(kept[0])
    assert renew_turnover(spark, *kept) == []
    assert kept_turnover(spark, kept[1]).collect() == []
