"""Splitting hot keys must not change any result."""

from __future__ import annotations

import pytest
from frames import rows_of
from pyspark.sql import functions as F

from crewlytics.operators.skew import (
    heavy_keys,
    hot_keys,
    key_counts,
    numbered,
    padded,
    split_rows,
    spread_both,
    spread_join,
    spread_outer,
)
from crewlytics.plans import tables, training
from crewlytics.sources.workforce import Workforce, settled

REPORTS = {
    "main": lambda w, hot: training.training_main(w, hot_rows=hot),
    "kpi": lambda w, hot: training.training_kpi_summary(w, hot_rows=hot),
    "details": lambda w, hot: training.training_full_details(w, limit=300, hot_rows=hot),
} | {
    name: (lambda w, hot, name=name: training.training_breakdown(w, name, hot_rows=hot))
    for name in training.BREAKDOWNS
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_hot_keys_give_the_same_report(name, workforce):
    report = REPORTS[name]
    assert rows_of(report(workforce, 3)) == rows_of(report(workforce, 10**9))


@pytest.fixture(scope="module")
def lopsided(given):
    """One event and one participant hold most rows, many of them exact copies."""
    people = [
        {"training_event_id": 1, "participant_id": i % 7, "participant_type": "Internal"}
        for i in range(60)
    ]
    people += [
        {"training_event_id": e, "participant_id": 3, "participant_type": "External"}
        for e in (2, 3, 3, 3)
    ]
    people += [{"training_event_id": 4, "participant_id": None}] * 5
    people += [{"training_event_id": None, "participant_id": 3}] * 5
    events = [
        {
            "training_event_id": e,
            "company_id": "C",
            "start_date": "2000-06-01",
            "training_duration": 10,
            "training_duration_unit": "Hour",
        }
        for e in (1, 2, 3, 4, 5)
    ]
    courses = [{"training_event_id": 1, "course_id": c % 3} for c in range(9)]
    spells = [
        {"emp_no": 3, "company_id": "C", "site_code": str(i % 2), "start_date": "2000-01-01"}
        for i in range(6)
    ]
    assigned = [
        {
            "emp_no": 3,
            "company_id": "C",
            "org_code": "O",
            "pos_code": f"p{i}",
            "valid_from": "2000-01-01",
            "valid_to": "2000-12-31",
        }
        for i in range(12)
    ]
    return given(
        training_event=events,
        training_participant=people,
        training_event_course=courses,
        work_spell=spells,
        company_pers_assign=assigned,
        position_dim=[{"company_id": "C", "pos_code": "p0", "position_title": "first"}],
        staff_group_dim=[{"company_id": "C", "site_code": "1", "group_name": "one"}],
    )


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_lopsided_keys_give_the_same_report(name, lopsided):
    report = REPORTS[name]
    split = rows_of(report(lopsided, 4))
    assert split == rows_of(report(lopsided, 10**9))
    assert split


def test_hot_key_is_split_and_cold_keys_are_not(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 90, 1).otherwise(F.col("id")).alias("k"))
    hot = hot_keys(key_counts(rows, ["k"]), ["k"], hot_rows=20)
    assert [tuple(r) for r in hot.collect()] == [(1, 5)]
    parts = split_rows(numbered(rows), hot, {"k": "k"}).groupBy("k").agg(
        F.count_distinct("_part").alias("n"), F.count("*").alias("rows")
    )
    spread = {r.k: (r.n, r.rows) for r in parts.collect()}
    assert spread[1] == (5, 90)
    assert all(n == 1 for k, (n, _) in spread.items() if k != 1)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_the_plain_join(spark, how):
    big = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    other = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c"), (9, "d")], "k long, w string")
    hot = hot_keys(key_counts(big, ["k"]), ["k"], hot_rows=10)
    found = spread_join(numbered(big), other, ["k"], hot, how).select("k", "v", "w")
    assert rows_of(found) == rows_of(big.join(other, "k", how))


def test_no_job_runs_while_a_report_is_built(workforce, spark):
    """One plan for every size: nothing is counted before the result is asked for."""
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    for report in REPORTS.values():
        report(workforce, 5_000_000)
    assert set(tracker.getJobIdsForGroup(None)) == before


@pytest.mark.parametrize("hot", [(5, 10**9), (10**9, 5), (5, 5), (10**9, 10**9)])
def test_grid_join_is_the_plain_join(spark, hot):
    """Many rows on the left, on the right, on both sides of one key."""
    left = spark.range(60).select((F.col("id") % 7 % 3).alias("k"), F.col("id").alias("a"))
    right = spark.range(50).select((F.col("id") % 9 % 4).alias("k"), F.col("id").alias("b"))
    hot_left = hot_keys(key_counts(left, ["k"]), ["k"], hot[0])
    hot_right = hot_keys(key_counts(right, ["k"]), ["k"], hot[1])
    found = spread_both(numbered(left), numbered(right), ["k"], hot_left, hot_right)
    assert rows_of(found.select("k", "a", "b")) == rows_of(left.join(right, "k"))


def test_events_with_one_id_and_without(given):
    """Two event rows with one id share its participations; an event without an id stays."""
    event = {"company_id": "C", "start_date": "2000-06-01", "training_duration": 10, "training_duration_unit": "Hour"}
    w = given(
        training_event=[{**event, "training_event_id": 1}, {**event, "training_event_id": 1, "company_id": "D"},
                        {**event, "company_id": "E"}, {**event, "company_id": "F"}],
        training_participant=[{"training_event_id": 1, "participant_id": 5}, {"training_event_id": None, "participant_id": 6}],
        training_event_course=[{"training_event_id": None, "course_id": 1}],
    )
    for hot_rows in (1, 10**9):
        for rows in (training.training_main(w, hot_rows=hot_rows), training.training_full_details(w, hot_rows=hot_rows)):
            found = {(r["event_id"], r["company"], r["participant_id"], r["hours_per_person"]) for r in rows.collect()}
            assert found == {(1, "C", 5, 5.0), (1, "D", 5, 5.0), (None, "E", None, 5.0), (None, "F", None, 5.0)}


def test_unknown_hours_and_zero(given):
    """A row that a sum leaves out adds 0: one cancelled row makes the totals 0, not NULL."""
    event = {"training_event_id": 1, "company_id": "C", "start_date": "2000-06-01", "training_duration": 10, "training_duration_unit": "Week"}
    row = {"training_event_id": 1, "participant_type": "External"}
    live = [{**row, "participant_id": 1}, {**row, "participant_id": 2}]
    gone = {**row, "participant_id": 3, "cancel_date": "2000-05-01"}
    for people, expected in ((live, None), ([*live, gone], 0.0)):
        kpi = training.training_kpi_summary(given(training_event=[event], training_participant=people)).first()
        assert (kpi["total_training_hours"], kpi["avg_hours_per_external"]) == (expected, expected)
        assert kpi["avg_hours_per_active_internal"] is None


@pytest.mark.parametrize("hot_rows", [2, 10**9])
def test_spread_outer_is_the_plain_left_join(spark, hot_rows):
    one = spark.createDataFrame([(k, f"n{k}") for k in range(6)], "k long, n string")
    many = spark.createDataFrame([(1, None)] * 9 + [(2, 5), (2, None), (None, 7)], "k long, c int")
    hot = hot_keys(key_counts(many, ["k"]), ["k"], hot_rows)
    found = spread_outer(one, numbered(many), ["k"], hot, "c IS NULL").select("k", "n", "c")
    assert rows_of(found) == rows_of(one.join(many, "k", "left").where("c IS NULL"))


def test_rows_in_another_order_get_the_same_numbers(spark):
    rows = [(k % 3, k % 7, None if k % 5 else k) for k in range(60)]
    schema = "training_event_id long, participant_id long, other long"

    def dealt(order):
        table = spark.createDataFrame(order, schema).coalesce(1)
        return sorted(map(tuple, numbered(settled(table, "training_participant")).collect()), key=repr)

    assert dealt(rows) == dealt(rows[::-1])


@pytest.mark.parametrize("hot_rows", [3, 9, 1000])
def test_heavy_keys_are_those_of_exact_counts(spark, hot_rows):
    rows = spark.range(4000).select(
        F.when(F.col("id") < 30, F.lit(None)).when(F.col("id") < 2030, 7).otherwise(F.col("id") % 300).alias("k")
    )
    exact = hot_keys(key_counts(rows.where("k IS NOT NULL"), ["k"]), ["k"], hot_rows)
    assert rows_of(heavy_keys(rows, "k", hot_rows)) == rows_of(exact)
    assert heavy_keys(rows.limit(0), "k", hot_rows).count() == 0


def test_adaptive_execution_splits_a_hot_event(spark, workforce, tmp_path):
    """Without a list of hot keys: no counting scan, and the uneven partition is split at run time."""
    hot = F.when(F.col("training_event_id") % 2 == 0, 2).otherwise(F.col("training_event_id"))
    path = str(tmp_path / "participants")
    w = workforce.training_participant.withColumn("training_event_id", hot)
    w.repartition(8).write.parquet(path)
    stored = Workforce(
        spark, lambda name: spark.read.parquet(path) if name == "training_participant" else getattr(workforce, name)
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        report = tables.training_uniques(stored)
        plan = lambda: report._jdf.queryExecution().executedPlan().toString()
        assert "_counter" not in plan()
        got = rows_of(report)
        assert "SortMergeJoin(skew=true)" in plan()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == rows_of(tables.training_uniques(stored))


def test_inner_join_with_padded_rows_is_the_left_join(spark):
    one = spark.createDataFrame([(k, f"n{k}") for k in (0, 1, 1, 2, 3, 3)], "k long, n string")
    many = spark.createDataFrame([(1, 4), (1, None), (2, 5), (None, 7), (8, 8)], "k long, c int")
    found = one.join(padded(numbered(many), one, ["k"]), "k").select("k", "n", "c")
    assert rows_of(found) == rows_of(one.join(many, "k", "left"))


def test_adaptive_execution_splits_a_hot_event_of_the_model(spark, workforce, tmp_path):
    """Both joins of participations and events, that of the counted rows and that of the whole ones."""
    hot = F.when(F.col("training_event_id") % 2 == 0, 2).otherwise(F.col("training_event_id"))
    path = str(tmp_path / "participants")
    w = workforce.training_participant.withColumn("training_event_id", hot)
    w.repartition(8).write.parquet(path)
    stored = Workforce(
        spark, lambda name: spark.read.parquet(path) if name == "training_participant" else getattr(workforce, name)
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        report = training.training_main(stored)
        got = rows_of(report)
        plan = report._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        joins = [line for line in plan.split("\n") if "SortMergeJoin(skew=true) [training_event_id" in line]
        assert len(joins) >= 2
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == rows_of(training.training_main(stored))
