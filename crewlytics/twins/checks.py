"""Twins of the table scans, operators, key checks and log jobs."""

from __future__ import annotations

from crewlytics.twins.training import BEST, RUNNING
from crewlytics.twins.views import over

SCANS = [
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

ATTENDED = """attended AS (
  SELECT p.*, x.company_id, x.start_date
  FROM training_participant p JOIN training_event x USING (training_event_id))"""
TRAINING = ["training_event", "training_participant"]
KEPT = "ts > TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 30 DAY"


def repeated(view: str, keys: str) -> str:
    missing = " OR ".join(f"{k} IS NULL" for k in keys.split(", "))
    return (
        over([view])
        + f"SELECT {keys}, count(*) AS rows FROM {view} GROUP BY ALL HAVING rows > 1 OR {missing}"
    )


def orphans(child: str, key: str, parent: str, parent_key: str) -> str:
    return (
        over([child, parent])
        + f"SELECT {key}, count(*) AS rows FROM {child} c WHERE {key} IS NOT NULL "
        f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_key} = c.{key}) GROUP BY ALL"
    )


CLEAN = r"""
  regexp_replace(
    regexp_replace(
      replace(replace(trim(replace(replace(generated_sql, ';', ''), '"', ''), E' \t\n\r'),
        '```sql', ''), '```', ''),
      'LIMIT\s+(\d+)', 'FETCH FIRST \1 ROWS ONLY', 'gi'),
    'SELECT\s+TOP\s+\d+\s+', 'SELECT ', 'gi')"""

TWINS = {f"scan_{name}": over([name]) + f"SELECT * FROM {name}" for name in SCANS} | {
    "headcount_search": over(["personnel"])
    + "SELECT department, count(emp_id) AS count FROM personnel WHERE org_ref = '1' "
    "AND is_regular = 1 AND department ILIKE '%ma%' GROUP BY 1 ORDER BY 2 DESC, 1",
    "adhoc_select": over(["personnel"])
    + "SELECT company, gender, count(emp_id) AS count, CAST(sum(is_active) AS BIGINT) AS active "
    "FROM personnel WHERE org_ref = '1' AND is_regular = 1 GROUP BY ALL",
    "adhoc_select_parts": over(["product", "sale", "course"])
    + "SELECT 'sale' AS kind, id, (SELECT CAST(sum(s.total) AS DOUBLE) FROM sale s WHERE s.product_id = product.id) AS work_spell "
    "FROM product WHERE id IN (SELECT product_id FROM sale) "
    "AND price > (SELECT sum(price) / count(price) FROM product) "
    "AND id NOT IN (SELECT course_id FROM course WHERE course_title = 'x')",
    "training_assignments": over([*TRAINING, "company_pers_assign"], BEST)
    + "SELECT b.* FROM training_participant p JOIN best b "
    "ON b.training_event_id = p.training_event_id AND b.emp_no = p.participant_id",
    "training_day_assignments": over([*TRAINING, "company_pers_assign"], BEST)
    + "SELECT DISTINCT b.emp_no, b.company_id, x.start_date, b.org_code, b.pos_code "
    "FROM best b JOIN training_event x USING (training_event_id)",
    "training_sites": over([*TRAINING, "work_spell"], ATTENDED)
    + "SELECT a.company_id, s.site_code, count(*) AS count FROM attended a LEFT JOIN work_spell s "
    "ON s.emp_no = a.participant_id AND s.company_id = a.company_id AND a.start_date "
    "BETWEEN s.start_date AND coalesce(s.end_date, DATE '2999-12-31') GROUP BY ALL",
    "training_activity": over([*TRAINING, "work_spell"], ATTENDED, RUNNING)
    + "SELECT DISTINCT a.participant_id AS emp_no, a.company_id, CAST(EXISTS (SELECT 1 "
    "FROM running r WHERE r.emp_no = a.participant_id AND r.company_id = a.company_id) AS INT) "
    "AS is_active FROM attended a",
    "training_course_names": over(["training_event_course", "course", "course_category"])
    + "SELECT training_event_id, (SELECT course_title FROM course c "
    "WHERE c.course_id = l.course_id) AS course_title, (SELECT category_name "
    "FROM course_category k JOIN course c USING (course_category_id) "
    "WHERE c.course_id = l.course_id) AS category_name FROM training_event_course l",
    "training_uniques": over(TRAINING, ATTENDED)
    + "SELECT company_id, count(DISTINCT participant_id) AS participants, "
    "count(DISTINCT participant_id) FILTER (participant_type = 'Internal') "
    "AS internal_participants FROM attended WHERE cancel_date IS NULL GROUP BY 1",
    "key_violations_product": repeated("product", "id"),
    "key_violations_sale": repeated("sale", "id"),
    "key_violations_event": repeated("training_event", "training_event_id"),
    "sale_before": over(["sale"])
    + "SELECT id, product_id, quantity, total, city, "
    "DATE '2024-02-05' - CAST(id % 30 AS INT) AS sold_on FROM sale",
    "key_violations_participant": repeated(
        "training_participant", "training_event_id, participant_id"
    ),
    "fk_orphans_sale_product": orphans("sale", "product_id", "product", "id"),
    "fk_orphans_event_course": orphans(
        "training_event_course", "course_id", "course", "course_id"
    ),
    "fk_orphans_participant_event": orphans(
        "training_participant", "training_event_id", "training_event", "training_event_id"
    ),
    "interactions_normalised": over(["interactions"])
    + f"SELECT *, {CLEAN} AS clean_sql, coalesce(regexp_matches(clean_sql, "
    "'^\\s*(INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)', 'i'), false) AS is_write FROM interactions",
    "interactions_retained": over(["interactions"]) + f"SELECT * FROM interactions WHERE {KEPT}",
    "interactions_appended": over(["interactions"]) + f"SELECT * FROM interactions WHERE {KEPT}",
    "interactions_upkept": over(["interactions"]) + f"SELECT * FROM interactions WHERE {KEPT}",
    "interactions_streamed": over(["interactions"]) + "SELECT * FROM interactions",
}
