"""Whole tables, ad-hoc selects, and the training operators one at a time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from crewlytics.functions.dates import days_before
from crewlytics.functions.text import contains_ci
from crewlytics.operators import participation as part
from crewlytics.operators.distribution import PEOPLE, Dim, distribution
from crewlytics.operators.filters import live, staff
from crewlytics.operators.kpis import count_when
from crewlytics.operators.matching import (
    assignment_timeline,
    assignments_on,
    exists_flag,
    running_spells,
)
from crewlytics.operators.participation import EVENT
from crewlytics.operators.sweep import interval_totals
from crewlytics.plans.training import AS_OF, hot_of
from crewlytics.sources.workforce import Workforce, run_select

SALES_AS_OF = dt.date(2024, 2, 5)

SCANNED = [
    "personnel",
    "personnel_month",
    "engagement",
    "training_event",
    "training_participant",
    "training_participant_qry",
    "training_event_course",
    "company_pers_assign",
    "work_spell",
    "interactions",
    "product",
    "sale",
]


def _scan(name: str) -> Callable[[Workforce], DataFrame]:
    def scan(w: Workforce) -> DataFrame:
        return getattr(w, name)

    scan.__name__ = f"scan_{name}"
    return scan


def headcount_search(w: Workforce, text: str = "ma", limit: int | None = None) -> DataFrame:
    """Regular employees per department, for departments whose name contains a text.

    All of them, or the ``limit`` largest.
    """
    found = staff(w.personnel, active=None).where(contains_ci(F.col("department"), text))
    return distribution(found, [Dim("department")], PEOPLE, ["-count"], limit)


def sale_before(w: Workforce, as_of: dt.date = SALES_AS_OF, days: int = 30) -> DataFrame:
    """The sales as if made in the ``days`` days up to ``as_of``, dealt to them by their id."""
    back = F.pmod(F.col("id"), F.lit(days)).cast("int")
    return w.sale.drop("sold_at").withColumn("sold_on", days_before(as_of, back))


def adhoc_select(w: Workforce) -> DataFrame:
    return run_select(
        w,
        "SELECT company, gender, count(emp_id) AS count, sum(is_active) AS active "
        "FROM personnel WHERE org_ref = '1' AND is_regular = 1 GROUP BY company, gender;",
    )


def adhoc_select_parts(w: Workforce) -> DataFrame:
    """A select with a WITH clause, aliases, a sub-select, and words that only look like tables."""
    return run_select(
        w,
        """WITH product AS (SELECT 'sale' AS kind, id, price FROM product), -- engagement
        sold AS (SELECT s.product_id, CAST(sum(s.total) AS DOUBLE) AS total FROM sale s GROUP BY s.product_id)
        SELECT interactions.kind, interactions.id, sold.total AS work_spell
        FROM product interactions JOIN sold ON sold.product_id = interactions.id /* org_dim */
        WHERE interactions.price > (SELECT avg(p.price) FROM product p)
        AND NOT EXISTS (SELECT 1 FROM course c WHERE c.course_id = interactions.id AND c.course_title = 'x')""",
    )


def _attendance(w: Workforce, hot: part.Hot) -> DataFrame:
    """Every participation with the company and day of its event."""
    events = w.training_event.select(EVENT, "company_id", "start_date")
    rows = part.participations(events, w.training_participant, hot)
    return rows.where(F.col("participant_id").isNotNull())


def _attended_days(w: Workforce) -> DataFrame:
    """Participations counted per participant, company and day."""
    rows = _attendance(w, hot_of(w))
    return rows.groupBy(F.col("participant_id").alias("emp_no"), "company_id", "start_date").agg(
        F.count(F.lit(1)).alias("times")
    )


def training_assignments(w: Workforce, hot_rows: int | None = None) -> DataFrame:
    """The assignment that counts for each participation."""
    hot = hot_of(w, hot_rows)
    rows = part.by_participant(_attendance(w, hot), hot)
    codes = ["org_code", "pos_code", "assigned"]
    matched = part.with_profile(rows, assignment_timeline(w.company_pers_assign), hot, *codes)
    return matched.where("assigned").select(
        EVENT, F.col("participant_id").alias("emp_no"), "company_id", "org_code", "pos_code"
    )


def training_day_assignments(w: Workforce) -> DataFrame:
    """The assignment that counts for each day an employee took part in something."""
    days = _attended_days(w).drop("times")
    return assignments_on(days, w.company_pers_assign, "start_date").where("assigned").drop(
        "assigned"
    )


def training_sites(w: Workforce) -> DataFrame:
    """Participations per site the participant worked at on the day."""
    totals = interval_totals(
        _attended_days(w),
        w.work_spell,
        ["emp_no", "company_id"],
        "start_date",
        "times",
        ("start_date", "end_date"),
        ["company_id"],
        "site_code",
    )
    return totals.withColumnRenamed("times", "count")


def training_activity(w: Workforce) -> DataFrame:
    """Participants of each company, and whether they still work there."""
    people = _attended_days(w).select("emp_no", "company_id").distinct()
    running = running_spells(w.work_spell, AS_OF)
    return exists_flag(
        people, running, {"emp_no": "emp_no", "company_id": "company_id"}, "active"
    ).select("emp_no", "company_id", F.col("active").cast("int").alias("is_active"))


def training_course_names(w: Workforce) -> DataFrame:
    return part.course_names(w.training_event_course, w.course, w.course_category)


def training_uniques(w: Workforce) -> DataFrame:
    """Distinct live participants per company, and the internal ones among them."""
    rows = live(_attendance(w, hot_of(w)))
    internal = part.is_internal()
    people = rows.groupBy("company_id", "participant_id").agg(F.max(internal).alias("internal"))
    return people.groupBy("company_id").agg(
        F.count("participant_id").alias("participants"),
        count_when(F.col("internal")).alias("internal_participants"),
    )


REPORTS = [
    *[_scan(name) for name in SCANNED],
    headcount_search,
    sale_before,
    adhoc_select,
    adhoc_select_parts,
    training_assignments,
    training_day_assignments,
    training_sites,
    training_activity,
    training_course_names,
    training_uniques,
]
