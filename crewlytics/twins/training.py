"""Twins of the training reports: the training model in plain SQL, rows and all."""

from __future__ import annotations

from crewlytics.twins.views import over

VIEWS = [
    "training_event",
    "training_participant",
    "training_event_course",
    "course",
    "course_category",
    "company_pers_assign",
    "work_spell",
    "position_dim",
    "org_dim",
    "staff_group_dim",
]

BEST = """best AS (
  SELECT x.training_event_id, a.emp_no, a.company_id, a.org_code, a.pos_code
  FROM training_participant p
  JOIN training_event x USING (training_event_id)
  JOIN company_pers_assign a ON a.emp_no = p.participant_id AND a.company_id = x.company_id
  QUALIFY row_number() OVER (
    PARTITION BY a.emp_no, x.training_event_id
    ORDER BY
      coalesce(a.org_code <> '001' AND a.valid_from <= x.start_date
               AND x.start_date <= a.valid_to, false) DESC,
      coalesce(a.is_primary = 1, false) DESC,
      a.valid_to DESC NULLS FIRST, a.valid_from NULLS LAST,
      a.pos_code NULLS LAST, a.org_code NULLS LAST) = 1)"""

RUNNING = """running AS (
  SELECT DISTINCT emp_no, company_id FROM work_spell
  WHERE start_date <= DATE '2000-01-01' AND coalesce(end_date > DATE '2000-01-01', true))"""

MAIN = """main AS (
  SELECT
    x.training_event_id AS event_id,
    coalesce(x.training_event_name, 'Bilgi Girilmemiş') AS training_name,
    coalesce(c.course_title, 'Bilgi Girilmemiş') AS category,
    coalesce(cc.category_name, 'Bilgi Girilmemiş') AS area,
    x.start_date, x.end_date, p.cancel_date,
    CAST(x.training_duration AS DOUBLE)
      * map{'Day': 8, 'Hour': 1}[x.training_duration_unit] AS hours,
    if(p.cancel_date IS NULL,
       hours / count(*) FILTER (p.cancel_date IS NULL) OVER (PARTITION BY x.training_event_id),
       0.0) AS hours_per_person,
    x.company_id AS company,
    p.participant_id,
    concat(p.participant_id, if(p.participant_type = 'Internal', 'DAHİLİ', 'HARİCİ'))
      AS participant_key,
    p.participant_name,
    CAST(coalesce(p.participant_type = 'Internal' AND run.emp_no IS NOT NULL, false) AS INT)
      AS is_active,
    if(p.participant_type = 'Internal', 'DAHİLİ', 'HARİCİ') AS participant_type,
    if(p.participant_type = 'Internal',
       upper(coalesce(pos.position_title, 'BİLGİ GİRİLMEMİŞ')), 'HARİCİ KATILIMCI') AS position,
    if(p.participant_type = 'External', 'PETLAS',
       coalesce(upper(o.org_name), 'BİLGİ GİRİLMEMİŞ!!')) AS department,
    if(p.participant_type = 'Internal',
       coalesce(g.group_name, 'Bilgi Yok!'), 'HARİCİ KATILIMCI') AS staff_group
  FROM training_event x
  LEFT JOIN training_event_course l USING (training_event_id)
  LEFT JOIN course c ON c.course_id = l.course_id
  LEFT JOIN course_category cc ON cc.course_category_id = c.course_category_id
  LEFT JOIN training_participant p ON p.training_event_id = x.training_event_id
  LEFT JOIN running run ON run.emp_no = p.participant_id AND run.company_id = x.company_id
  LEFT JOIN best b ON b.training_event_id = x.training_event_id
                  AND b.emp_no = p.participant_id
  LEFT JOIN work_spell s ON s.emp_no = b.emp_no AND s.company_id = b.company_id
                        AND x.start_date >= s.start_date
                        AND (s.end_date IS NULL OR x.start_date <= s.end_date)
  LEFT JOIN position_dim pos ON pos.company_id = x.company_id AND pos.pos_code = b.pos_code
  LEFT JOIN org_dim o ON o.company_id = x.company_id AND o.org_code = b.org_code
  LEFT JOIN staff_group_dim g ON g.company_id = s.company_id AND g.site_code = s.site_code)"""

WITH_MAIN = over(VIEWS, BEST, RUNNING, MAIN)
LIVE = "FROM main WHERE cancel_date IS NULL"
IS_LIVE = "cancel_date IS NULL"
INSIDE = f"{IS_LIVE} AND participant_type = 'DAHİLİ' AND is_active = 1"
OUTSIDE = f"{IS_LIVE} AND participant_type = 'HARİCİ'"


def breakdown(column: str) -> str:
    return (
        WITH_MAIN + f"SELECT {column} AS name, count(DISTINCT participant_id) AS participant_count, "
        f"count(DISTINCT event_id) AS training_count {LIVE} "
        "GROUP BY 1 ORDER BY participant_count DESC, name, training_count LIMIT 100"
    )


UNTRAINED = (
    over(["personnel", "training_participant_qry"], """untrained AS (
  SELECT * FROM personnel WHERE org_ref = '1' AND is_active = 1
  AND emp_id NOT IN (SELECT participant_id FROM training_participant_qry))""")
)

ORDERED = """SELECT * FROM main ORDER BY start_date DESC NULLS FIRST, event_id, training_name, category,
  area, end_date, cancel_date NULLS LAST, hours NULLS LAST, hours_per_person NULLS LAST, company,
  participant_id NULLS LAST, participant_key, participant_name NULLS LAST, is_active,
  participant_type, position, department, staff_group LIMIT 2000"""

TWINS = {
    "training_kpi_summary": WITH_MAIN
    + f"""SELECT
    count(CASE WHEN {IS_LIVE} THEN participant_key END) AS total_participants,
    count(DISTINCT CASE WHEN {IS_LIVE} THEN participant_key END) AS unique_participants,
    count(CASE WHEN {INSIDE} THEN participant_key END) AS active_internal_total,
    count(DISTINCT CASE WHEN {INSIDE} THEN participant_key END) AS active_internal_unique,
    count(DISTINCT CASE WHEN {OUTSIDE} THEN participant_key END) AS external_unique,
    round(sum(CASE WHEN {IS_LIVE} THEN hours_per_person ELSE 0 END), 2) AS total_training_hours,
    round(sum(CASE WHEN {INSIDE} THEN hours ELSE 0 END)
      / nullif(count(CASE WHEN {INSIDE} THEN participant_key END), 0), 2)
      AS avg_hours_per_active_internal,
    round(sum(CASE WHEN {OUTSIDE} THEN hours ELSE 0 END)
      / nullif(count(CASE WHEN {OUTSIDE} THEN participant_key END), 0), 2)
      AS avg_hours_per_external
  FROM main""",
    "training_counts": WITH_MAIN + f"SELECT count(DISTINCT event_id) AS total_trainings_count {LIVE}",
    "training_top": WITH_MAIN + "SELECT training_name, count(DISTINCT event_id) AS count "
    f"{LIVE} GROUP BY 1 ORDER BY count DESC, training_name LIMIT 10",
    "training_monthly_trend": WITH_MAIN + "SELECT strftime(start_date, '%Y-%m') AS month, "
    f"count(DISTINCT event_id) AS count {LIVE} GROUP BY 1 ORDER BY month DESC NULLS FIRST LIMIT 24",
    "training_breakdown_position": breakdown("position"),
    "training_breakdown_department": breakdown("department"),
    "training_breakdown_group": breakdown("staff_group"),
    "training_breakdown_category": breakdown("category"),
    "training_breakdown_area": breakdown("area"),
    "training_calendar": WITH_MAIN + "SELECT DISTINCT start_date, event_id AS id, "
    f"training_name AS title, end_date, company {LIVE} AND start_date > DATE '2000-01-01' "
    "ORDER BY start_date, id, title, end_date, company LIMIT 50",
    "training_none_list": UNTRAINED + "SELECT company, location, department, "
    "position_title AS position, emp_id, full_name FROM untrained "
    "ORDER BY company, department, location, position, emp_id, full_name LIMIT 1000",
    "training_none_screened": UNTRAINED + "SELECT emp_id, full_name, company, department FROM untrained",
    "training_none_count": UNTRAINED + "SELECT count(DISTINCT emp_id) AS count FROM untrained",
    "training_full_details": WITH_MAIN + ORDERED,
    "training_main": WITH_MAIN + "SELECT * FROM main",
}
