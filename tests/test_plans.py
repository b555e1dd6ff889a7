"""The shapes Spark should choose."""

from __future__ import annotations

import inspect
import re

import pytest
from frames import DATA, rows_of

import __spark_entry__ as entry_points
from crewlytics import catalogue
from crewlytics.operators.matching import assignment_timeline
from crewlytics.plans import employees, location, movements, training


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_untrained_staff_is_an_anti_join(workforce):
    assert "LeftAnti" in optimized(training.training_none_count(workforce))


@pytest.mark.parametrize(
    "report",
    [
        employees.employees_dist_position,
        employees.employees_city_stats,
        location.location_employee_list,
        movements.turnover_details,
        training.training_top,
        training.training_full_details,
    ],
)
def test_limits_keep_the_best_rows_per_task(workforce, report):
    assert "TakeOrderedAndProject" in physical(report(workforce))


def test_best_of_group_drops_losers_before_the_shuffle(workforce):
    assert "WindowGroupLimit" in physical(assignment_timeline(workforce.company_pers_assign))


def test_scan_reads_only_the_needed_columns(workforce):
    plan = physical(employees.employees_dist_location(workforce))
    orders = re.search(r"FileScan parquet \[(o_[^\]]*)\].*orders\.parquet", plan)
    assert {c.split("#")[0] for c in orders.group(1).split(",")} == {
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
    }


def test_filters_reach_the_scan(spark, workforce, tmp_path):
    from crewlytics.sources.workforce import Workforce, write_views

    write_views(workforce, str(tmp_path), ["personnel"])
    stored = Workforce.stored(spark, str(tmp_path))
    report = employees.employees_dist_location
    plan = physical(report(stored))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: struct<([^>]*)>", plan)
    for condition in ("EqualTo(org_ref,1)", "EqualTo(is_active,1)", "EqualTo(is_regular,1)"):
        assert condition in pushed.group(1)
    assert {c.split(":")[0] for c in pushed.group(2).split(",")} == {
        "emp_id", "location", "org_ref", "is_active", "is_regular",
    }
    assert rows_of(report(stored)) == rows_of(report(workforce))


def test_stored_months_are_pruned(spark, workforce, tmp_path):
    from crewlytics.sources.workforce import Workforce, write_views

    write_views(workforce, str(tmp_path), ["personnel_month"])
    stored = Workforce.stored(spark, str(tmp_path)).personnel_month
    one = stored.where("year_month = '199805'")
    assert re.search(r"PartitionFilters: \[[^\]]*year_month", physical(one))
    assert one.count() == workforce.personnel_month.where("year_month = '199805'").count()


REPORTS = entry_points.catalogue.reports() | entry_points.catalogue.directory_reports()


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_python_in_any_plan(name, spark):
    if name in ("interactions_streamed", "interactions_appended", "interactions_upkept"):
        pytest.skip("writes a table first; its own plan is a scan")
    plan = optimized(entry_points.queries()[name](spark, DATA))
    assert not re.search(r"PythonUDF|MapInPandas|FlatMapGroups|ArrowEval|BatchEval", plan)
    assert "Cartesian" not in plan and not re.search(r"Join Cross", plan)


def test_big_sides_are_not_broadcast(spark, workforce):
    """With sizes over the threshold every join but the hot-key list is a shuffle."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for category in training.BREAKDOWNS:
            plan = physical(training.training_breakdown(workforce, category, hot_rows=10))
            for side in re.findall(r"BroadcastExchange[^\n]*\n([^\n]*)", plan):
                assert "_hot_" in side, side
            assert "NestedLoop" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_limits_are_arguments(workforce):
    reports = catalogue.reports()
    limited = {
        name: inspect.signature(report).parameters["limit"].default
        for name, report in reports.items()
        if "limit" in inspect.signature(report).parameters
    }
    assert len(limited) >= 30
    assert limited["headcount_search"] is None
    departments = workforce.personnel.select("department").distinct().count()
    assert reports["employees_department_stats"](workforce, limit=None).count() == departments
    assert reports["employees_department_stats"](workforce, limit=1).count() == 1
    rows = reports["training_main"](workforce).count()
    assert rows > 2000
    assert reports["training_full_details"](workforce, limit=None).count() == rows


def test_participations_are_dealt_by_event_and_by_person_only(workforce, spark):
    """Whole rows cross the network twice, and the narrow ones that are counted twice."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = training.training_main(workforce)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
        dealt = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", plan)
        assert sum("participant_name#" in columns for columns in dealt) == 2
        assert sum("participant_id#" in columns for columns in dealt) == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
