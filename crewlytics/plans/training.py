"""Training reports.

Each report takes only the part of the training model it needs.  Reports that count
distinct events or participants are not affected by repeated rows, so they leave out the
joins that only repeat rows; the figures that do count rows carry the repetition as a
weight instead of producing the rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from crewlytics.functions import fixed_values as fv
from crewlytics.functions.dates import day_of, month_key
from crewlytics.functions.numbers import ratio
from crewlytics.functions.text import labelled
from crewlytics.operators import participation as part
from crewlytics.operators.bloom import WORDS
from crewlytics.operators.filters import after, staff
from crewlytics.operators.kpis import count_when, kpi_row
from crewlytics.operators.matching import running_spells, without_match
from crewlytics.operators.ordering import ranked
from crewlytics.operators.participation import EVENT
from crewlytics.operators.skew import (
    ROW,
    dealt_anew,
    heavy_keys,
    key_counts,
    numbered,
    padded,
    spread_both,
    spread_join,
)
from crewlytics.sources.workforce import Workforce

AS_OF = dt.date(2000, 1, 1)
BROADCAST_IDS = 100_000
WHO = ["participant_id", "company_id", "start_date"]


def _event_name() -> Column:
    return labelled(F.col("training_event_name"), fv.TRAINING_UNKNOWN)


def hot_of(w: Workforce, hot_rows: int | None = None) -> part.Hot:
    """The keys that hold more than ``hot_rows`` rows of the two long tables.

    Each list is worked out only in a query that uses it.  Without a limit no keys are looked
    for, and adaptive execution splits what turns out uneven.
    """
    if hot_rows is None:
        return part.Hot(None, None, None)
    if hot_rows < 1:
        raise ValueError("hot_rows must be positive")

    def hot(table: DataFrame, key: str) -> DataFrame:
        return heavy_keys(table, key, hot_rows)

    people, links = w.training_participant, w.training_event_course
    return part.Hot(hot(people, EVENT), hot(people, "participant_id"), hot(links, EVENT))


def training_main(
    w: Workforce,
    as_of: dt.date = AS_OF,
    hot_rows: int | None = None,
    outside: str = fv.OUTSIDE_DEPARTMENT,
) -> DataFrame:
    """One row per event, course, participant and matching work spell: 18 columns.

    The number of live rows of an event, which its hours are divided by, is counted
    after all of these repetitions.  Event rows with one id all count, and share what
    belongs to it; an event without an id has no participants and no courses.  ``outside`` is
    the department shown for people from elsewhere.
    """
    hot = hot_of(w, hot_rows)
    events = _timed(w.training_event.where(F.col(EVENT).isNotNull()))
    people = padded(numbered(w.training_participant), events, [EVENT])
    running = running_spells(w.work_spell, as_of)
    profile = part.staff_profile(w.company_pers_assign, running, w.position_dim, w.org_dim)
    sites = part.site_groups(w.company_pers_assign, w.work_spell, w.staff_group_dim)

    # Live rows of an event: its live rows so far, once for each of its course links.
    # Few columns of many rows look small in a file; merging keeps them from being broadcast.
    live = people.where(part.IS_LIVE).select(EVENT, "participant_id", ROW).hint("merge")
    dated = events.select(EVENT, "company_id", "start_date")
    present = part.by_participant(spread_join(live, dated, [EVENT], hot.events), hot)
    counted = part.with_site_groups(present, sites, hot).groupBy(EVENT).agg(
        F.count(F.lit(1)).alias("_live")
    )
    courses = key_counts(w.training_event_course, [EVENT])
    total = F.col("_live") * F.coalesce("_rows", F.lit(1))
    shares = counted.join(courses, EVENT, "left").select(EVENT, total.alias("_live"))

    # All that is known of an event meets its participants first, so each of their rows is dealt
    # twice, by event and by person, and not by event once more.
    links = numbered(w.training_event_course)
    named = part.course_names(links, w.course, w.course_category)
    named = padded(named, events, [EVENT], w.training_event_course)
    offered = spread_join(named, events, [EVENT], hot.courses).join(shares, EVENT, "left")
    if hot.events is None:
        offered = dealt_anew(offered, [EVENT])
    rows = spread_both(people, offered, [EVENT], hot.events, hot.courses)
    rows = part.by_participant(rows, hot)
    titled = part.with_profile(rows, profile, hot, "position_title", "org_name", "is_active")
    main = part.with_site_groups(titled, sites, hot)
    main = main.unionByName(_timed(_without_id(w.training_event)), allowMissingColumns=True)
    live_rows = F.coalesce("_live", F.lit(0))

    internal = part.is_internal()
    return main.select(
        F.col(EVENT).alias("event_id"),
        _event_name().alias("training_name"),
        labelled(F.col("course_title"), fv.TRAINING_UNKNOWN).alias("category"),
        labelled(F.col("category_name"), fv.TRAINING_UNKNOWN).alias("area"),
        "start_date",
        "end_date",
        "cancel_date",
        "hours",
        part.hours_per_person(F.col("hours"), live_rows).alias("hours_per_person"),
        F.col("company_id").alias("company"),
        "participant_id",
        part.participant_key(internal).alias("participant_key"),
        "participant_name",
        F.when(internal & F.col("is_active"), 1).otherwise(0).alias("is_active"),
        part.type_label(internal).alias("participant_type"),
        part.position_label(internal).alias("position"),
        part.department_label(outside).alias("department"),
        part.group_label(internal).alias("staff_group"),
    )


def _timed(events: DataFrame) -> DataFrame:
    """The hours of each event as one short number, in place of what they come from."""
    timed = events.withColumn("hours", part.event_hours().cast("double"))
    return timed.drop("training_duration", "training_duration_unit")


def _without_id(events: DataFrame) -> DataFrame:
    """Events without an id: nothing belongs to them, and they count as one event's rows."""
    rows = events.where(F.col(EVENT).isNull()).withColumn("_one", F.lit(1))
    total = rows.groupBy("_one").agg(F.count(F.lit(1)).alias("_live"))
    return rows.join(F.broadcast(total), "_one").drop("_one")


def training_kpi_summary(
    w: Workforce, as_of: dt.date = AS_OF, hot_rows: int | None = None
) -> DataFrame:
    """Participation counts and hours.

    Rows are first added up per participant, type, company and start day, so the joins
    that follow see each employee at most once per day however often they took part.
    """
    courses = key_counts(w.training_event_course, [EVENT]).withColumnRenamed("_rows", "_courses")
    events = (
        w.training_event.withColumn("_hours", part.event_hours())
        .join(courses, EVENT, "left")
        .withColumn("_courses", F.coalesce("_courses", F.lit(1)))
        .select(EVENT, "company_id", "start_date", "_hours", "_courses")
    )
    taken = part.participations(events, w.training_participant, hot_of(w, hot_rows), only_live=True)
    daily = taken.groupBy(*WHO, part.is_internal().alias("internal")).agg(
        F.sum("_courses").alias("rows"), F.sum(F.col("_hours") * F.col("_courses")).alias("hours")
    )
    flags = part.staff_flags(w.company_pers_assign, w.work_spell, as_of)
    flagged = daily.join(
        flags.withColumnRenamed("emp_no", "participant_id"), ["participant_id", "company_id"], "left"
    )
    spelled = flagged.alias("d").join(
        part.spell_counts(w.work_spell).alias("s"),
        [
            F.col("d.participant_id") == F.col("s.emp_no"),
            F.col("d.company_id") == F.col("s.company_id"),
            F.col("d.assigned"),
            F.col("d.start_date").between(F.col("s.spell_from"), F.col("s.spell_to")),
        ],
        "left",
    )
    repeats = F.coalesce("_spells", F.lit(1))
    spelled = spelled.withColumns(
        {"rows": F.col("rows") * repeats, "hours": F.col("hours") * repeats}
    )

    inside = F.col("internal") & F.coalesce("active", F.lit(False))
    per_person = spelled.groupBy("participant_id", "internal").agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(inside, F.col("rows")).otherwise(0)).alias("inside_rows"),
        F.sum(F.when(inside, F.col("hours"))).alias("inside_hours"),
        F.sum("hours").alias("hours"),
    )
    total = allocated_hours(w.training_event, w.training_participant)
    parts = per_person.unionByName(total, allowMissingColumns=True)

    external = ~F.col("internal")
    rows, inside_rows = F.sum("rows"), F.sum("inside_rows")
    external_rows = F.sum(F.when(external, F.col("rows")).otherwise(0))
    cancelled = F.coalesce(F.sum("cancelled"), F.lit(0)) > 0

    def average(hours: Column, own_rows: Column) -> Column:
        """Rows that the condition leaves out add 0, so the sum is NULL only without them."""
        some = F.coalesce(hours, F.when((rows > own_rows) | cancelled, 0))
        return F.round(ratio(some, own_rows), 2)

    return kpi_row(
        parts,
        {
            "total_participants": F.coalesce(rows, F.lit(0)),
            "unique_participants": F.count("rows"),
            "active_internal_total": F.coalesce(inside_rows, F.lit(0)),
            "active_internal_unique": count_when(F.col("inside_rows") > 0),
            "external_unique": count_when(external),
            "total_training_hours": F.round(F.sum("allocated"), 2).cast("double"),
            "avg_hours_per_active_internal": average(F.sum("inside_hours"), inside_rows),
            "avg_hours_per_external": average(
                F.sum(F.when(external, F.col("hours"))), external_rows
            ),
        },
    )


def allocated_hours(events: DataFrame, participants: DataFrame) -> DataFrame:
    """Hours handed out to live rows, one value, and the number of cancelled rows.

    The shares of one event add up to its hours, so the events with a live row are summed.
    A cancelled row hands out 0, also where the event's hours are unknown.
    """
    counted = events.join(part.participant_counts(participants), EVENT, "left")
    handed_out = F.expr("_rows IS NULL OR _live_rows > 0")
    hours = F.when(handed_out, part.event_hours())
    value = F.coalesce(hours, F.when(F.expr("_rows > _live_rows"), 0))
    lost = F.sum(F.expr("_rows - _live_rows"))
    return counted.agg(F.sum(value).alias("allocated"), lost.alias("cancelled"))


def training_counts(w: Workforce) -> DataFrame:
    events = part.live_events(w.training_event, w.training_participant)
    return events.agg(F.count_distinct(EVENT).alias("total_trainings_count"))


def _events_by(w: Workforce, name: str, key: Column, order: list[str], limit: int | None) -> DataFrame:
    events = part.live_events(w.training_event, w.training_participant)
    counted = events.groupBy(key.alias(name)).agg(F.count_distinct(EVENT).alias("count"))
    return ranked(counted, order, limit)


def training_top(w: Workforce, limit: int | None = 10) -> DataFrame:
    return _events_by(w, "training_name", _event_name(), ["-count"], limit)


def training_monthly_trend(w: Workforce, limit: int | None = 24) -> DataFrame:
    return _events_by(w, "month", month_key(F.col("start_date")), ["-month"], limit)


def training_calendar(w: Workforce, as_of: dt.date = AS_OF, limit: int | None = 50) -> DataFrame:
    events = part.live_events(after(w.training_event, "start_date", as_of), w.training_participant)
    rows = events.select(
        day_of(F.col("start_date")).alias("start_date"),
        F.col(EVENT).alias("id"),
        _event_name().alias("title"),
        "end_date",
        F.col("company_id").alias("company"),
    )
    return ranked(rows.distinct(), ["start_date"], limit)


def _live_rows(w: Workforce, hot: part.Hot) -> DataFrame:
    narrow = w.training_event.select(EVENT, "company_id", "start_date")
    return part.participations(narrow, w.training_participant, hot, only_live=True)


def _by_position(w: Workforce, hot: part.Hot) -> DataFrame:
    profile = part.staff_profile(w.company_pers_assign, positions=w.position_dim)
    rows = part.by_participant(_live_rows(w, hot), hot)
    titled = part.with_profile(rows, profile, hot, "position_title")
    return titled.withColumn("name", part.position_label(part.is_internal()))


def _by_department(w: Workforce, hot: part.Hot) -> DataFrame:
    profile = part.staff_profile(w.company_pers_assign, orgs=w.org_dim)
    rows = part.by_participant(_live_rows(w, hot), hot)
    titled = part.with_profile(rows, profile, hot, "org_name")
    return titled.withColumn("name", part.department_label())


def _by_group(w: Workforce, hot: part.Hot) -> DataFrame:
    sites = part.site_groups(w.company_pers_assign, w.work_spell, w.staff_group_dim).distinct()
    rows = part.by_participant(_live_rows(w, hot), hot)
    placed = part.with_site_groups(rows, sites, hot)
    return placed.withColumn("name", part.group_label(part.is_internal()))


def _by_course(w: Workforce, hot: part.Hot, column: str) -> DataFrame:
    links = part.course_names(w.training_event_course, w.course, w.course_category)
    offered = links.select(EVENT, column).distinct()
    name = labelled(F.col(column), fv.TRAINING_UNKNOWN).alias("name")
    named = w.training_event.select(EVENT).join(offered, EVENT, "left").select(EVENT, name)
    return part.participations(named, w.training_participant, hot, only_live=True)


def _by_category(w: Workforce, hot: part.Hot) -> DataFrame:
    return _by_course(w, hot, "course_title")


def _by_area(w: Workforce, hot: part.Hot) -> DataFrame:
    return _by_course(w, hot, "category_name")


BREAKDOWNS = {
    "position": _by_position,
    "department": _by_department,
    "group": _by_group,
    "category": _by_category,
    "area": _by_area,
}


def training_breakdown(
    w: Workforce, category: str, hot_rows: int | None = None, limit: int | None = 100
) -> DataFrame:
    """Distinct participants and events per value of one of five columns."""
    if category not in BREAKDOWNS:
        raise ValueError(f"unknown category {category!r}; choose from {', '.join(BREAKDOWNS)}")
    named = BREAKDOWNS[category](w, hot_of(w, hot_rows))
    counted = named.groupBy("name").agg(
        F.count_distinct("participant_id").alias("participant_count"),
        F.count_distinct(EVENT).alias("training_count"),
    )
    return ranked(counted, ["-participant_count"], limit)


def training_breakdown_position(w: Workforce, limit: int | None = 100) -> DataFrame:
    return training_breakdown(w, "position", limit=limit)


def training_breakdown_department(w: Workforce, limit: int | None = 100) -> DataFrame:
    return training_breakdown(w, "department", limit=limit)


def training_breakdown_group(w: Workforce, limit: int | None = 100) -> DataFrame:
    return training_breakdown(w, "group", limit=limit)


def training_breakdown_category(w: Workforce, limit: int | None = 100) -> DataFrame:
    return training_breakdown(w, "category", limit=limit)


def training_breakdown_area(w: Workforce, limit: int | None = 100) -> DataFrame:
    return training_breakdown(w, "area", limit=limit)


def _untrained(w: Workforce) -> DataFrame:
    employees = staff(w.personnel, regular=None)
    return without_match(employees, w.training_participant_qry, {"emp_id": "participant_id"})


def training_none_list(w: Workforce, limit: int | None = 1000) -> DataFrame:
    rows = _untrained(w).select(
        "company",
        "location",
        "department",
        F.col("position_title").alias("position"),
        "emp_id",
        "full_name",
    )
    return ranked(rows, ["company", "department"], limit)


def training_none_screened(w: Workforce, bloom_words: int = WORDS) -> DataFrame:
    """All of them, whatever their number; those a Bloom filter knows to be untrained skip the join."""
    employees = staff(w.personnel, regular=None).select("emp_id", "full_name", "company", "department")
    return without_match(employees, w.training_participant_qry, {"emp_id": "participant_id"}, bloom_words)


def training_none_count(w: Workforce) -> DataFrame:
    return _untrained(w).agg(F.count_distinct("emp_id").alias("count"))


def training_full_details(
    w: Workforce, limit: int | None = 2000, hot_rows: int | None = None
) -> DataFrame:
    """The latest rows of the training model, or all of them.

    Every event yields at least one row and the sort starts with start day and event id,
    so the wanted rows belong to the first ``limit`` events in that order.  The model is
    built for those events only; up to ``BROADCAST_IDS`` ids are broadcast to the scans of
    the tables keyed by event, more are left to Spark's own choice of join.  Assignments and spells are those of their participants.
    """
    if limit is None:
        return ranked(training_main(w, hot_rows=hot_rows), ["-start_date", "event_id"])
    first = ranked(w.training_event.select("start_date", EVENT), ["-start_date"], limit)
    ids = first.select(EVENT)
    if limit <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    keyed = ["training_event", "training_participant", "training_event_course"]
    chosen = w.narrowed(ids, EVENT, keyed)
    people = chosen.training_participant.select(F.col("participant_id").alias("emp_no"))
    staffed = chosen.narrowed(people.distinct(), "emp_no", ["company_pers_assign", "work_spell"])
    return ranked(training_main(staffed, hot_rows=hot_rows), ["-start_date", "event_id"], limit)


REPORTS = [
    training_kpi_summary,
    training_counts,
    training_top,
    training_monthly_trend,
    training_breakdown_position,
    training_breakdown_department,
    training_breakdown_group,
    training_breakdown_category,
    training_breakdown_area,
    training_calendar,
    training_none_list,
    training_none_count,
    training_none_screened,
    training_full_details,
    training_main,
]
