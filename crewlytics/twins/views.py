"""The derived views as common table expressions over the star-schema tables."""

from __future__ import annotations

from crewlytics.sources import view_columns as vc

PLACES = (
    "orders o JOIN customer c ON c.c_custkey = o.o_custkey "
    "JOIN nation n ON n.n_nationkey = c.c_nationkey "
    "JOIN region r ON r.r_regionkey = n.n_regionkey"
)
STEPS = "(SELECT 0 AS k UNION ALL SELECT 1 AS k) d"

SOURCES = {
    "personnel": PLACES,
    "personnel_month": "lineitem l JOIN personnel p ON p.emp_id = l.l_orderkey",
    "engagement": "personnel p",
    "training_event": PLACES,
    "training_participant": "lineitem l",
    "training_participant_qry": "lineitem l",
    "training_event_course": f"orders o JOIN {STEPS} ON d.k = 0 OR o.o_orderkey % 50 = 0",
    "course": "part p",
    "course_category": "(SELECT DISTINCT p_type FROM part WHERE p_type <> 'PROMO') p",
    "company_pers_assign": f"supplier s CROSS JOIN region r CROSS JOIN {STEPS}",
    "work_spell": (
        f"supplier s CROSS JOIN region r CROSS JOIN {STEPS} "
        "WHERE (s.s_suppkey + r.r_regionkey + d.k) % 4 <> 0"
    ),
    "position_dim": "nation n CROSS JOIN region r WHERE n.n_nationkey % 6 <> 5",
    "org_dim": "nation n CROSS JOIN region r WHERE n.n_nationkey < 18",
    "staff_group_dim": "region r CROSS JOIN nation n WHERE n.n_nationkey < 4",
    "interactions": "events e",
    "product": "part p",
    "sale": "lineitem l",
}
NEEDS = {"personnel_month": ["personnel"], "engagement": ["personnel"]}


def view(name: str) -> str:
    columns = ", ".join(f"{sql} AS {c}" for c, sql in getattr(vc, name.upper()).items())
    return f"{name} AS (SELECT {columns} FROM {SOURCES[name]})"


def over(views: list[str], *ctes: str) -> str:
    """A WITH clause holding the views, what they need, and further expressions."""
    names: list[str] = []
    for name in views:
        names += [n for n in [*NEEDS.get(name, []), name] if n not in names]
    return "WITH " + ",\n".join([*(view(n) for n in names), *ctes]) + "\n"
