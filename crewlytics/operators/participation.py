"""The training model: who took part in which event, in which role, for how many hours."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from crewlytics.functions import fixed_values as fv
from crewlytics.functions.dates import open_ended
from crewlytics.functions.numbers import ratio, training_hours
from crewlytics.functions.text import joined, labelled, upper_text
from crewlytics.operators.kpis import count_when
from crewlytics.operators.matching import assignment_timeline, in_stretch, lookup, running_spells
from crewlytics.operators.skew import (
    dealt_anew,
    numbered,
    repeat_rows,
    same_part,
    split_rows,
    spread_outer,
)

EVENT = "training_event_id"
IS_LIVE = "cancel_date IS NULL"


def is_internal() -> Column:
    """True for internal participants only; a missing type counts as external."""
    return F.coalesce(F.col("participant_type") == fv.INTERNAL, F.lit(False))


def type_label(internal: Column) -> Column:
    return F.when(internal, fv.INTERNAL_LABEL).otherwise(fv.EXTERNAL_LABEL)


def participant_key(internal: Column) -> Column:
    """Participant id and type label in one text; a missing id leaves the label alone."""
    return joined(F.col("participant_id"), type_label(internal))


def event_hours() -> Column:
    """Hours of an event, exact; sums of them do not depend on the order of rows."""
    return training_hours(F.col("training_duration"), F.col("training_duration_unit"))


def participant_counts(participants: DataFrame) -> DataFrame:
    """Rows and live rows per event."""
    return participants.groupBy(EVENT).agg(
        F.count(F.lit(1)).alias("_rows"), count_when(F.expr(IS_LIVE)).alias("_live_rows")
    )


def live_events(events: DataFrame, participants: DataFrame) -> DataFrame:
    """Events with a participation that was not cancelled, or with none at all.

    These are the events seen by any report that counts events over live rows; one row
    per event, so neither popular events nor course links multiply anything.
    """
    counted = events.join(participant_counts(participants), EVENT, "left")
    return counted.where("_rows IS NULL OR _live_rows > 0").drop("_rows", "_live_rows")


@dataclass(frozen=True)
class Hot:
    """Keys with very many rows.

    Events and participants of the participation table, events of the course links; None
    leaves them to adaptive execution.
    """

    events: DataFrame | None
    people: DataFrame | None
    courses: DataFrame | None


def participations(
    events: DataFrame, participants: DataFrame, hot: Hot, only_live: bool = False
) -> DataFrame:
    """Every event with each of its participants; an event without any is kept once."""
    return spread_outer(
        events, numbered(participants), [EVENT], hot.events, IS_LIVE if only_live else "true"
    )


def by_participant(rows: DataFrame, hot: Hot) -> DataFrame:
    """Marks rows with their part of a hot participant, for the joins below."""
    return split_rows(rows, hot.people, {"participant_id": "participant_id"})


def staff_profile(
    assignments: DataFrame,
    running: DataFrame | None = None,
    positions: DataFrame | None = None,
    orgs: DataFrame | None = None,
) -> DataFrame:
    """Per employee, company and stretch of days: the assignment and what is known with it.

    Look-ups and the activity flag are attached here, to the small side, so that a
    participation needs a single join to get all of them.  A report passes only the
    tables it shows something of.
    """
    profile = assignment_timeline(assignments, running)
    if positions is not None:
        profile = lookup(profile, positions, ["company_id", "pos_code"], "position_title")
    if orgs is not None:
        profile = lookup(profile, orgs, ["company_id", "org_code"], "org_name")
    return profile


def staff_flags(assignments: DataFrame, spells: DataFrame, as_of: dt.date) -> DataFrame:
    """Per employee and company: any assignment, and a spell running at ``as_of``."""
    who = ["emp_no", "company_id"]
    assigned = assignments.select(*who, F.lit(True).alias("assigned"), F.lit(False).alias("active"))
    running = running_spells(spells, as_of).select(*who, F.lit(False), F.lit(True))
    return assigned.union(running).groupBy(*who).agg(
        F.max("assigned").alias("assigned"), F.max("active").alias("active")
    )


def site_groups(assignments: DataFrame, spells: DataFrame, groups: DataFrame) -> DataFrame:
    """Work spells of employees that have an assignment, with the staff group of the site."""
    who = ["emp_no", "company_id"]
    counted = spells.join(assignments.select(*who).distinct(), who, "left_semi")
    return lookup(counted, groups, ["company_id", "site_code"], "group_name").select(
        *who,
        F.col("start_date").alias("spell_from"),
        open_ended(F.col("end_date")).alias("spell_to"),
        "group_name",
    )


def spell_counts(spells: DataFrame) -> DataFrame:
    """Work spells with equal bounds as one row and their number."""
    bounds = [F.col("start_date").alias("spell_from"), open_ended(F.col("end_date")).alias("spell_to")]
    return spells.groupBy("emp_no", "company_id", *bounds).agg(F.count(F.lit(1)).alias("_spells"))


def _same_person() -> list[Column]:
    return [
        F.col("r.participant_id") == F.col("s.emp_no"),
        F.col("r.company_id") == F.col("s.company_id"),
        *same_part("r", "s"),
    ]


def _anew(side: DataFrame, hot: Hot) -> DataFrame:
    return dealt_anew(side, ["emp_no", "company_id"]) if hot.people is None else side


def with_profile(rows: DataFrame, profile: DataFrame, hot: Hot, *columns: str) -> DataFrame:
    """Adds profile columns by participant, company and the day the event starts."""
    side = repeat_rows(_anew(profile, hot), hot.people, {"emp_no": "participant_id"}).alias("s")
    stretch = in_stretch(F.col("r.start_date"), F.col("s.from_day"), F.col("s.until_day"))
    added = [F.col(f"s.{c}") for c in columns]
    return rows.alias("r").join(side, [*_same_person(), stretch], "left").select("r.*", *added)


def with_site_groups(rows: DataFrame, sites: DataFrame, hot: Hot) -> DataFrame:
    """Adds the group of each work spell that contains the day the event starts."""
    side = repeat_rows(_anew(sites, hot), hot.people, {"emp_no": "participant_id"}).alias("s")
    spell = F.col("r.start_date").between(F.col("s.spell_from"), F.col("s.spell_to"))
    return rows.alias("r").join(side, [*_same_person(), spell], "left").select(
        "r.*", "s.group_name"
    )


def course_names(links: DataFrame, courses: DataFrame, categories: DataFrame) -> DataFrame:
    """Course title and category name per event and course link."""
    catalogue = lookup(courses, categories, ["course_category_id"], "category_name")
    named = catalogue.select("course_id", "course_title", "category_name")
    return links.join(named, "course_id", "left").drop("course_id")


def position_label(internal: Column) -> Column:
    title = upper_text(labelled(F.col("position_title"), fv.POSITION_UNKNOWN))
    return F.when(internal, title).otherwise(fv.OUTSIDE_PARTICIPANT)


def department_label(outside: str = fv.OUTSIDE_DEPARTMENT) -> Column:
    org = labelled(upper_text(F.col("org_name")), fv.DEPARTMENT_UNKNOWN)
    return F.when(F.col("participant_type") == fv.EXTERNAL, outside).otherwise(org)


def group_label(internal: Column) -> Column:
    group = labelled(F.col("group_name"), fv.GROUP_UNKNOWN)
    return F.when(internal, group).otherwise(fv.OUTSIDE_PARTICIPANT)


def hours_per_person(hours: Column, live_rows: Column) -> Column:
    """Event hours shared among the live rows; 0 for a cancelled row."""
    return F.when(F.col("cancel_date").isNull() & (live_rows > 0), ratio(hours, live_rows)).otherwise(
        F.lit(0.0)
    )
