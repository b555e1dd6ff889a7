"""Sorted passes over days and bounds against loops, also for a person with very many bounds."""

from __future__ import annotations

import datetime as dt
import heapq
import math
import random
from collections import Counter

import pytest
from frames import rows_of
from pyspark.sql import functions as F

from crewlytics.operators import matching
from crewlytics.operators.distribution import Dim, distributions
from crewlytics.operators.sweep import carried, interval_totals, tree_nodes, tree_path
from crewlytics.plans import employees, tables
from crewlytics.sources.schemas import view_schema

WHO = ["emp_no", "company_id"]
DAY = dt.date(2000, 1, 1)


def later(days):
    return None if days is None else DAY + dt.timedelta(days=days)


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tree_nodes_cover_each_place_once(spark):
    spans = [(i, j, 70) for i in range(1, 70) for j in range(i + 1, 70)]
    df = spark.createDataFrame(spans, "i int, j int, n int")
    found = df.select("i", "j", tree_nodes("i", "j").alias("nodes")).collect()
    for row in found:
        covered = [p for k, node in row.nodes for p in range(node << k, (node + 1) << k)]
        assert sorted(covered) == list(range(row.i, row.j))
        assert len(row.nodes) <= 2 * math.log2(row.j) + 1
    above = spark.range(71).select(F.lit(71).alias("n"), F.col("id").cast("int").alias("p"))
    for row in above.select("p", tree_path("p", "n").alias("path")).collect():
        assert [tuple(step) for step in row.path] == [(k, row.p >> k) for k in range(7)]


def test_carried_values_of_missing_days_and_keys(spark):
    marks = [(1, "A", None, "first"), (1, "A", later(5), "second"), (2, "A", later(3), "late"),
             (None, "A", None, "nobody's"), (1, None, None, "nowhere's")]
    asked = [(1, "A", d) for d in (None, later(-9), later(4), later(5), later(99))]
    asked += [(2, "A", None), (2, "A", later(2)), (2, "A", later(3)), (None, "A", later(1)), (1, None, None)]
    since = spark.createDataFrame(marks, "emp_no long, company_id string, since date, v string")
    days = spark.createDataFrame(asked, "emp_no long, company_id string, day date")
    found = {tuple(r[:3]): r.v for r in carried(days, since, WHO, "day", "since", "v").collect()}
    expected = ["first", "first", "first", "second", "second", None, None, "late", None, None]
    assert found == dict(zip(asked, expected))
    assert carried(days, since.limit(0), WHO, "day", "since", "v").where("v IS NOT NULL").count() == 0
    assert carried(days.limit(0), since, WHO, "day", "since", "v").count() == 0


def totals_by_loops(days, spells):
    out = Counter()
    for emp, company, day, times in days:
        sites = [
            site
            for e, c, site, start, end in spells
            if None not in (e, c, start, day)
            and (e, c) == (emp, company)
            and start <= day
            and (end is None or day <= end)
        ]
        for site in sites or [None]:
            out[company, site] += times
    return dict(out)


@pytest.mark.parametrize("seed", range(5))
def test_interval_totals_against_loops(spark, seed):
    rng = random.Random(seed)
    days = {
        (rng.choice([1, 2, 3, None]), rng.choice(["A", "B", None]), later(rng.choice([None, *range(20)])))
        for _ in range(80)
    }
    days = [(*d, rng.randint(1, 5)) for d in days]
    spells = [
        (rng.choice([1, 2, None]), rng.choice(["A", "B", None]), rng.choice(["x", "y", None]),
         later(rng.choice([None, *range(20)])), later(rng.choice([None, *range(20)])))
        for _ in range(30)
    ]
    spells += spells[:5]
    asked = spark.createDataFrame(days, "emp_no long, company_id string, day date, times long")
    spans = spark.createDataFrame(
        spells, "emp_no long, company_id string, site string, since date, until date"
    )
    for s, rows in ((spans, spells), (spans.limit(0), [])):
        found = interval_totals(asked, s, WHO, "day", "times", ("since", "until"), ["company_id"], "site")
        assert {(r.company_id, r.site): r.times for r in found.collect()} == totals_by_loops(days, rows)


def test_ten_thousand_spells_of_one_person(spark):
    """Results as by counting, from a plan in which days and spells never meet in a join."""
    rng = random.Random(7)
    spells = [(1, "A", f"s{rng.randrange(20)}", a, a + rng.randrange(3000)) for a in rng.choices(range(9000), k=10_000)]
    days = [(1, "A", later(d), 1 + d % 3) for d in range(0, 12_500)]
    asked = spark.createDataFrame(days, "emp_no long, company_id string, day date, times long")
    spans = spark.createDataFrame(
        [(e, c, s, later(a), later(b)) for e, c, s, a, b in spells],
        "emp_no long, company_id string, site string, since date, until date",
    )
    found = interval_totals(asked, spans, WHO, "day", "times", ("since", "until"), ["company_id"], "site")
    until = [0]
    for *_, times in days:
        until.append(until[-1] + times)
    expected, covered = Counter(), set()
    for _, _, site, a, b in spells:
        expected[site] += until[b + 1] - until[a]
        covered.update(range(a, b + 1))
    expected[None] = sum(t for i, (*_, t) in enumerate(days) if i not in covered)
    assert {r.site: r.times for r in found.collect()} == {k: v for k, v in expected.items() if v}
    assert "Join" not in optimized(found)


def test_ten_thousand_assignments_of_one_person(spark):
    """The preferred of many overlapping assignments, from n log n rows."""
    n, rng = 10_000, random.Random(3)
    spans = [(a, a + rng.randrange(1, 6000)) for a in rng.choices(range(30_000), k=n)]
    rows = [(1, "A", "O", f"p{i:05}", later(a), later(b), i % 2) for i, (a, b) in enumerate(spans)]
    assignments = spark.createDataFrame(rows, view_schema("company_pers_assign"))
    assert matching._best_by_node(assignments, WHO).count() <= 2 * n * math.log2(2 * n)

    asked = list(range(-5, 36_100, 50))
    days = spark.createDataFrame([(1, "A", later(d)) for d in asked], "emp_no long, company_id string, day date")
    found = {r.day: r.pos_code for r in matching.assignments_on(days, assignments, "day").collect()}

    def preference(i):
        a, b = spans[i]
        return (1 if i % 2 else 2, -b, a, i)

    fallback = min(range(n), key=preference)
    opening = sorted(range(n), key=lambda i: spans[i][0])
    heap, at = [], 0
    for day in asked:
        while at < n and spans[opening[at]][0] <= day:
            heapq.heappush(heap, (preference(opening[at]), opening[at]))
            at += 1
        while heap and spans[heap[0][1]][1] < day:
            heapq.heappop(heap)
        best = heap[0][1] if heap else fallback
        assert found[later(day)] == f"p{best:05}", day


def test_distributions_equal_the_single_ones(workforce):
    found = rows_of(employees.employees_distributions(workforce))
    single = {
        "position": employees.employees_dist_position(workforce, limit=None),
        "location": employees.employees_dist_location(workforce),
        "company": employees.employees_dist_company(workforce),
        "collar_type": employees.employees_dist_collar(workforce),
        "marital_status": employees.employees_dist_marital(workforce),
        "employment_status": employees.employees_dist_employment_status(workforce),
    }
    expected = [(name, *row) for name, report in single.items() for row in rows_of(report)]
    assert found == sorted(expected, key=repr)
    scans = [
        employees.employees_distributions(workforce), employees.employees_dist_location(workforce)
    ]
    many, one = (optimized(df).count("Relation [") for df in scans)
    assert many == one


def test_distributions_tell_missing_from_not_grouped(spark):
    rows = [(None, "x"), (None, None), ("Other", None)]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("emp_id", F.lit(1))
    dims = {"a": Dim("a", shown_label="Other"), "b": Dim("b"), "b2": Dim("b", key_label="none")}
    found = rows_of(distributions(df, dims, {"count": "count(emp_id)"}))
    expected = [("a", "Other", 2), ("a", "Other", 1), ("b", None, 2), ("b", "x", 1), ("b2", "none", 2), ("b2", "x", 1)]
    assert found == sorted(expected, key=repr)
    assert distributions(df.limit(0), dims, {"count": "count(emp_id)"}).count() == 0


def test_uniques_are_folded_without_copies_of_rows(workforce):
    assert "Expand" not in optimized(tables.training_uniques(workforce))
