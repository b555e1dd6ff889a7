"""The training model against a plain nested-loop reading of its rules."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crewlytics.operators.matching import assignment_match, exists_flag, spell_join
from crewlytics.plans import training

AS_OF = training.AS_OF
FAR = dt.date(2999, 12, 31)


def _date(text):
    return None if text is None else dt.date.fromisoformat(text)


def brute_assignment(assignments, emp, company, start):
    """The first assignment in the stated order, or None."""
    mine = [a for a in assignments if a["emp_no"] == emp and a["company_id"] == company]

    def valid(a):
        low, high = _date(a["valid_from"]), _date(a["valid_to"])
        known = None not in (low, high, start, a["org_code"])
        return known and low <= start <= high and a["org_code"] != "001"

    def order(a):
        end, begin = _date(a["valid_to"]), _date(a["valid_from"])
        return (
            not valid(a),
            a["is_primary"] != 1,
            (0, 0) if end is None else (1, -end.toordinal()),
            (1, 0) if begin is None else (0, begin.toordinal()),
            (a["pos_code"] is None, a["pos_code"] or ""),
            (a["org_code"] is None, a["org_code"] or ""),
        )

    return min(mine, key=order) if mine else None


def brute_main(tables):
    """Rows of the model: (event, course, participant, hours per person, unit, site …)."""
    rows = []
    for x in tables["training_event"]:
        event = x["training_event_id"]
        links = [c for c in tables["training_event_course"] if c["training_event_id"] == event]
        people = [p for p in tables["training_participant"] if p["training_event_id"] == event]
        start = _date(x["start_date"])
        for link in links or [None]:
            for p in people or [None]:
                best = p and brute_assignment(
                    tables["company_pers_assign"], p["participant_id"], x["company_id"], start
                )
                spells = [
                    s
                    for s in tables["work_spell"]
                    if best
                    and start
                    and (s["emp_no"], s["company_id"]) == (best["emp_no"], best["company_id"])
                    and _date(s["start_date"]) <= start <= (_date(s["end_date"]) or FAR)
                ]
                for _spell in spells or [None]:
                    rows.append((x, link, p, best))
    out = []
    for x, link, p, best in rows:
        unit = {"Day": 8, "Hour": 1}.get(x["training_duration_unit"])
        hours = None if unit is None else float(x["training_duration"] * unit)
        live = sum(
            1 for y, _, q, _ in rows if y is x and (q is None or q.get("cancel_date") is None)
        )
        is_live = p is None or p.get("cancel_date") is None
        share = 0.0 if not is_live else (None if hours is None else hours / live)
        internal = bool(p) and p["participant_type"] == "Internal"
        out.append(
            (
                x["training_event_id"],
                p and p["participant_id"],
                ("" if p is None else str(p["participant_id"])) + ("DAHİLİ" if internal else "HARİCİ"),
                hours,
                share,
                "HARİCİ KATILIMCI"
                if not internal
                else (best["pos_code"] or "BİLGİ GİRİLMEMİŞ").upper()
                if best
                else "BİLGİ GİRİLMEMİŞ",
            )
        )
    return sorted(out, key=repr)


def run_main(w, hot_rows):
    found = training.training_main(w, hot_rows=hot_rows).select(
        "event_id", "participant_id", "participant_key", "hours", "hours_per_person", "position"
    )
    return sorted((tuple(r) for r in found.collect()), key=repr)


def random_tables(seed):
    rng = random.Random(seed)
    day = lambda: dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(12))
    maybe = lambda value, share=0.15: None if rng.random() < share else value
    events = [
        {
            "training_event_id": e,
            "company_id": rng.choice("AB"),
            "start_date": maybe(str(day())),
            "training_duration": rng.randrange(1, 9),
            "training_duration_unit": rng.choice(["Day", "Hour", "Week"]),
        }
        for e in range(8)
    ]
    participants = [
        {
            "training_event_id": rng.randrange(7),
            "participant_id": rng.randrange(5),
            "participant_type": rng.choice(["Internal", "Internal", "External", None]),
            "cancel_date": maybe(str(day()), 0.7),
        }
        for _ in range(25)
    ]
    assignments = [
        {
            "emp_no": rng.randrange(4),
            "company_id": rng.choice("AB"),
            "org_code": rng.choice(["001", "O1", "O2", None]),
            "pos_code": f"p{i}",
            "valid_from": maybe(str(day())),
            "valid_to": maybe(str(day())),
            "is_primary": rng.choice([0, 1]),
        }
        for i in range(18)
    ]
    spells = [
        {
            "emp_no": rng.randrange(4),
            "company_id": rng.choice("AB"),
            "seq_no": i,
            "site_code": "1",
            "start_date": str(day()),
            "end_date": maybe(str(day()), 0.4),
        }
        for i in range(12)
    ]
    links = [{"training_event_id": rng.randrange(8), "course_id": c} for c in range(5)]
    positions = [
        {"company_id": c, "pos_code": f"p{i}", "position_title": f"p{i}"}
        for c in "AB"
        for i in range(18)
    ]
    return {
        "training_event": events,
        "training_participant": participants,
        "company_pers_assign": assignments,
        "work_spell": spells,
        "training_event_course": links,
        "position_dim": positions,
    }


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot_rows", [2, 10**9])
def test_model_matches_nested_loops(given, seed, hot_rows):
    tables = random_tables(seed)
    assert run_main(given(**tables), hot_rows) == brute_main(tables)


@pytest.mark.parametrize("seed", range(6))
def test_assignment_match_is_the_first_of_all(given, make, seed):
    tables = random_tables(100 + seed)
    w = given(**tables)
    days = [None, *[f"2000-01-{d:02}" for d in range(1, 15)]]
    asked = [(e, c, _date(d)) for e in range(5) for c in "AB" for d in days]
    requests = w.spark.createDataFrame(asked, "emp_no long, company_id string, start_date date")
    found = {
        (r.emp_no, r.company_id, r.start_date): (r.assigned, r.org_code, r.pos_code)
        for r in assignment_match(requests, w.company_pers_assign, "start_date").collect()
    }
    assert len(found) == len(asked)
    for request in asked:
        best = brute_assignment(tables["company_pers_assign"], *request)
        expected = (True, best["org_code"], best["pos_code"]) if best else (False, None, None)
        assert found[request] == expected, request


ASSIGNED = {"emp_no": 1, "company_id": "A", "org_code": "O1", "pos_code": "p", "is_primary": 0}
EVENT = {
    "training_event_id": 1,
    "company_id": "A",
    "start_date": "2000-06-01",
    "training_duration": 6,
    "training_duration_unit": "Hour",
}
PERSON = {"training_event_id": 1, "participant_id": 1, "participant_type": "Internal"}


def matched(given, start, *assignments):
    w = given(company_pers_assign=[ASSIGNED | a for a in assignments])
    request = w.spark.createDataFrame([(1, "A", _date(start))], "emp_no long, company_id string, d date")
    return assignment_match(request, w.company_pers_assign, "d").first().pos_code


def test_validity_is_closed_on_both_ends(given):
    inside = {"valid_from": "2000-01-10", "valid_to": "2000-01-20", "pos_code": "in"}
    other = {"valid_from": "1990-01-01", "valid_to": "1990-01-02", "pos_code": "out", "is_primary": 1}
    chosen = {day: matched(given, f"2000-01-{day}", inside, other) for day in ("09", "10", "20", "21")}
    assert chosen == {"09": "out", "10": "in", "20": "in", "21": "out"}


def test_only_excluded_units_fall_back_to_primary_then_latest_end(given):
    span = {"org_code": "001", "valid_from": "2000-01-01"}
    rows = [
        span | {"valid_to": "2000-12-31", "pos_code": "late"},
        span | {"valid_to": "2000-06-30", "pos_code": "main", "is_primary": 1},
    ]
    assert matched(given, "2000-02-01", *rows) == "main"
    assert matched(given, "2000-02-01", rows[0], span | {"valid_to": "2000-03-01"}) == "late"


def test_open_end_is_never_valid_but_sorts_first(given):
    open_end = {"valid_from": "1999-01-01", "valid_to": None, "pos_code": "open"}
    closed = {"valid_from": "1999-01-01", "valid_to": "2001-01-01", "pos_code": "closed"}
    assert matched(given, "2000-02-01", open_end, closed) == "closed"
    assert matched(given, "2002-02-01", open_end, closed) == "open"


def shares(w):
    rows = training.training_main(w).select("participant_id", "hours_per_person").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_event_without_participants(given):
    row = training.training_main(given(training_event=[EVENT])).first()
    assert (row.participant_type, row.participant_key, row.hours_per_person) == ("HARİCİ", "HARİCİ", 6.0)
    assert row.department == "BİLGİ GİRİLMEMİŞ!!"
    assert row.position == row.staff_group == "HARİCİ KATILIMCI"


def test_two_courses_halve_the_share(given):
    links = [{"training_event_id": 1, "course_id": c} for c in (1, 2)]
    w = given(training_event=[EVENT], training_participant=[PERSON], training_event_course=links)
    assert shares(w) == [(1, 3.0), (1, 3.0)]


def test_cancelled_row_gets_nothing_and_is_not_counted(given):
    gone = PERSON | {"cancel_date": "2000-05-01"}
    w = given(training_event=[EVENT], training_participant=[PERSON, gone])
    assert shares(w) == [(1, 0.0), (1, 6.0)]


def test_overlapping_spells_repeat_the_row(given):
    spells = [
        {"emp_no": 1, "company_id": "A", "seq_no": i, "site_code": str(i), "start_date": "2000-01-01"}
        for i in (0, 1)
    ]
    w = given(
        training_event=[EVENT],
        training_participant=[PERSON],
        work_spell=spells,
        company_pers_assign=[ASSIGNED],
    )
    assert shares(w) == [(1, 3.0), (1, 3.0)]
    without = given(training_event=[EVENT], training_participant=[PERSON], work_spell=spells)
    assert shares(without) == [(1, 6.0)]


def test_week_has_no_hours(given):
    w = given(training_event=[EVENT | {"training_duration_unit": "Week"}])
    row = training.training_main(w).first()
    assert (row.hours, row.hours_per_person) == (None, None)


def test_spell_ending_on_the_day_is_not_running(given):
    def active(end):
        w = given(
            training_event=[EVENT],
            training_participant=[PERSON],
            work_spell=[
                {"emp_no": 1, "company_id": "A", "start_date": "1999-01-01", "end_date": end}
            ],
        )
        return training.training_main(w, as_of=AS_OF).first().is_active

    assert [active(end) for end in ("2000-01-01", "2000-01-02", None)] == [0, 1, 1]


def test_kpi_counts_by_company_and_type(given):
    events = [EVENT, EVENT | {"training_event_id": 2, "company_id": "B"}]
    people = [
        PERSON,
        PERSON | {"training_event_id": 2},
        PERSON | {"participant_type": "External", "participant_id": 9},
        PERSON | {"participant_id": 8, "cancel_date": "2000-01-01"},
    ]
    spells = [{"emp_no": 1, "company_id": "A", "start_date": "1999-01-01"}]
    row = training.training_kpi_summary(
        given(training_event=events, training_participant=people, work_spell=spells)
    ).first()
    assert tuple(row) == (3, 2, 1, 1, 1, 12.0, 6.0, 6.0)


def test_kpi_over_nothing(given):
    assert tuple(training.training_kpi_summary(given()).first()) == (0, 0, 0, 0, 0, None, None, None)


def test_event_whose_rows_are_all_cancelled_is_not_counted(given):
    gone = PERSON | {"cancel_date": "2000-05-01"}
    w = given(training_event=[EVENT], training_participant=[gone])
    assert training.training_counts(w).first()[0] == 0
    assert training.training_kpi_summary(w).first().total_training_hours == 0.0
    assert training.training_top(w).count() == 0


def test_hours_of_an_event_add_up(workforce):
    live = training.training_main(workforce).where("cancel_date IS NULL AND hours IS NOT NULL")
    totals = live.groupBy("event_id").agg(
        F.sum("hours_per_person").alias("given"), F.first("hours").alias("hours")
    )
    assert totals.where("abs(given - hours) > 1e-9").count() == 0


def test_none_count_is_the_length_of_the_list(workforce):
    count = training.training_none_count(workforce).first()[0]
    assert count == training.training_none_list(workforce).count() == 18


def test_unknown_breakdown_is_an_error(workforce):
    with pytest.raises(ValueError, match="unknown category"):
        training.training_breakdown(workforce, "salary")


def test_spell_join_and_exists_flag(given):
    person = {"emp_no": 1, "company_id": "A"}
    w = given(
        work_spell=[
            person | {"site_code": "x", "start_date": "2000-01-01", "end_date": "2000-01-31"},
            person | {"site_code": "y", "start_date": "2000-01-31"},
        ]
    )
    days = [(1, "A", _date(d)) for d in ("1999-12-31", "2000-01-31", "2500-01-01")] + [(2, "A", None)]
    asked = w.spark.createDataFrame(days, "emp_no long, company_id string, day date")
    found = spell_join(asked, w.work_spell, "day").collect()
    assert sorted((r.emp_no, str(r.day), r.site_code) for r in found if r.site_code) == [
        (1, "2000-01-31", "x"),
        (1, "2000-01-31", "y"),
        (1, "2500-01-01", "y"),
    ]
    assert len(found) == 5
    flagged = exists_flag(asked, w.work_spell, {"emp_no": "emp_no"}, "known").collect()
    assert [(r.emp_no, r.known) for r in flagged] == [(1, True)] * 3 + [(2, False)]
