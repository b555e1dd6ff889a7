"""Twins of the reports over the snapshot, the month history and the engagement view."""

from __future__ import annotations

from crewlytics.twins.views import over

STAFF = "org_ref = '1' AND is_active = 1 AND is_regular = 1"
ACTIVE = "is_active = 1"
STUDENTS = "org_ref = '1' AND is_active = 1 AND staff_type IN ('Stajyer', 'Çırak')"
EDU = "coalesce(education, 'EĞİTİM BİLGİSİ BOŞ')"
NO_INFO = "BİLGİ GİRİLMEMİŞ!!"


def _tail(order: str, limit: int | None) -> str:
    return f" ORDER BY {order} LIMIT {limit}" if limit else ""


def grouped(
    shown: str, keys: str, where: str = STAFF, order: str = "", limit: int | None = None
) -> str:
    """Counts per group; ``shown`` is the select list, ``keys`` the grouping."""
    return (
        over(["personnel"])
        + f"SELECT {shown}, count(emp_id) AS count FROM personnel WHERE {where} GROUP BY {keys}"
        + _tail(order, limit)
    )


def plain(names: str, where: str = STAFF, limit: int | None = None) -> str:
    """Counts per unlabelled columns, biggest first when limited."""
    ties = ", ".join(f"{n.strip()} NULLS LAST" for n in names.split(","))
    return grouped(names, names, where, f"count(emp_id) DESC, {ties}", limit)


def hits(condition: str) -> str:
    """Rows meeting a condition; NULL, not 0, where there are no rows at all."""
    return f"CAST(sum(CAST(coalesce({condition}, false) AS INT)) AS BIGINT)"


def figures(items: dict[str, str], where: str) -> str:
    columns = ", ".join(f"{sql} AS {name}" for name, sql in items.items())
    return over(["personnel"]) + f"SELECT {columns} FROM personnel WHERE {where}"


def durations(shown: str, keys: str, limit: int | None = None) -> str:
    averages = ", ".join(
        f"coalesce(round(CAST(sum({c}) AS DOUBLE) / count({c}), 6), 0) AS avg_{c}"
        for c in ("work_duration", "leave_duration")
    )
    select = f"SELECT {shown + ', ' if shown else ''}{averages} FROM engagement"
    group = f" GROUP BY {keys}" if keys else ""
    order = f"avg_work_duration DESC, {keys} NULLS LAST"
    return over(["engagement"]) + f"{select} WHERE org_ref = '1'{group}" + _tail(order, limit)


EMPLOYEES = {
    "employees_kpi_summary": figures(
        {
            "total_active": hits("is_active = 1"),
            "new_hires": hits("is_hire = 1"),
            "leavers": hits("is_leaver = 1"),
            "total_male": hits("is_active = 1 AND gender = 'ERKEK'"),
            "total_female": hits("is_active = 1 AND gender = 'KADIN'"),
            "total_disabled": hits("is_active = 1 AND is_disabled = 1"),
            "avg_age": "round(avg(age) FILTER (is_active = 1), 1)",
            "female_ratio": (
                "round(CAST(count(*) FILTER (is_active = 1 AND gender = 'KADIN') AS DOUBLE)"
                " / nullif(count(*) FILTER (is_active = 1), 0) * 100, 1)"
            ),
        },
        "org_ref = '1' AND is_regular = 1",
    ),
    "employees_dist_position": plain("position", limit=100),
    "employees_dist_location": plain("location"),
    "employees_dist_company": plain("company"),
    "employees_dist_collar": grouped(
        "coalesce(staff_group, 'Diğer') AS collar_type", "staff_group"
    ),
    "employees_dist_marital": grouped(
        "coalesce(marital_status, 'Bilinmiyor') AS status", "marital_status"
    ),
    "employees_dist_employment_status": grouped(
        "coalesce(employment_status, 'Diğer') AS status", "employment_status"
    ),
    "employees_distributions": over(["personnel"])
    + " UNION ALL ".join(
        f"SELECT '{name}' AS distribution, {shown} AS category, count(emp_id) AS count "
        f"FROM personnel WHERE {STAFF} GROUP BY {name.replace('collar_type', 'staff_group')}"
        for name, shown in {
            "position": "position",
            "location": "location",
            "company": "company",
            "collar_type": "coalesce(staff_group, 'Diğer')",
            "marital_status": "coalesce(marital_status, 'Bilinmiyor')",
            "employment_status": "coalesce(employment_status, 'Diğer')",
        }.items()
    ),
    "employees_disabled": plain(
        "location, department, position, disability_degree, gender",
        f"{STAFF} AND is_disabled = 1",
        1000,
    ),
    "employees_duty_place": grouped(
        "coalesce(duty_place, 'GÖREV YERİ BİLGİSİ YOK') AS duty_place",
        "1",
        order="count DESC, 1",
        limit=1000,
    ),
    "employees_company_position": grouped(
        "company, location, coalesce(position, 'POZISYON BİLGİSİ YOK') AS position",
        "1, 2, 3",
        order="count DESC, 1, 2, 3",
        limit=1000,
    ),
    "employees_demographics_basic": grouped(
        f"company, location, {EDU} AS education, gender",
        "1, 2, 3, 4",
        order="company, 3 DESC, location, gender",
        limit=1000,
    ),
    "employees_demographics_full": grouped(
        f"company, location, coalesce(position, 'POZISYON BİLGİSİ BOŞ') AS position, gender, "
        f"{EDU} AS education",
        "1, 2, 3, 4, 5",
        order="count DESC, 1, 2, 3, 4, 5",
        limit=1000,
    ),
    "employees_department_stats": over(["personnel"])
    + "SELECT department AS category, CAST(sum(is_active) AS BIGINT) AS value FROM personnel "
    f"WHERE {ACTIVE} GROUP BY 1 ORDER BY value DESC NULLS FIRST, category LIMIT 15",
    "employees_age_stats": over(["personnel"])
    + "SELECT CASE WHEN age_band IS NOT NULL THEN age_band WHEN age IS NULL THEN 'Bilinmiyor' "
    "WHEN age < 20 THEN '20 Altı' WHEN age < 30 THEN '20-29 Yaş' WHEN age < 40 THEN '30-39 Yaş' "
    "WHEN age < 50 THEN '40-49 Yaş' ELSE '50 Üzeri' END AS category, "
    f"CAST(sum(is_active) AS BIGINT) AS value FROM personnel WHERE {ACTIVE} GROUP BY 1",
    "employees_city_stats": over(["personnel"])
    + "SELECT residence_city AS category, CAST(sum(is_active) AS BIGINT) AS value FROM personnel "
    f"WHERE {ACTIVE} AND residence_city <> '{NO_INFO}' GROUP BY 1 "
    "ORDER BY value DESC NULLS FIRST, category LIMIT 10",
}

EDUCATION = {
    "education_kpi_summary": figures(
        {"total_employees": "count(emp_id)"}
        | {
            name: hits(f"education = '{text}'")
            for name, text in [
                ("phd", "DOKTORA"),
                ("master", "YÜKSEK LİSANS"),
                ("bachelor", "LİSANS"),
                ("associate", "ÖN LİSANS"),
                ("high_school", "LİSE"),
                ("vocational_high_school", "MESLEK LİSESİ"),
                ("primary_education", "İLKÖĞRETİM"),
                ("middle_school", "ORTAOKUL"),
                ("primary_school", "İLKOKUL"),
                ("literate", "OKUR YAZAR"),
            ]
        }
        | {"no_info": hits(f"education IS NULL OR education = '{NO_INFO}'")},
        STAFF,
    ),
    "education_age_heatmap": grouped(
        "coalesce(education, 'Bilinmiyor') AS education, coalesce(age_band, 'Diğer') AS age_group",
        "1, 2",
    ),
    "education_level_dist": grouped(
        f"{EDU} AS education, min(education_level) AS level_code", "1"
    ),
    "education_gender_dist": grouped(f"{EDU} AS education, gender", "1, 2"),
    "education_location_gender": grouped(
        f"company, location, {EDU} AS education, gender",
        "1, 2, 3, 4",
        order="location, company, 3, gender, count",
        limit=1000,
    ),
    "education_department": grouped(
        f"company, location, department, {EDU} AS education, gender",
        "1, 2, 3, 4, 5",
        order="company, location DESC, department, 4, gender",
        limit=1000,
    ),
    "education_position_location": grouped(
        f"company, location, position, {EDU} AS education, gender",
        "1, 2, 3, 4, 5",
        order="position NULLS LAST, gender DESC NULLS FIRST, company, location, 4",
        limit=1000,
    ),
    "education_position": grouped(
        f"coalesce(position, 'POZİSYON BİLGİSİ BOŞ') AS position, {EDU} AS education, gender",
        "1, 2, 3",
        order="1, gender DESC NULLS FIRST, 2",
        limit=1000,
    ),
}

AGE = {
    "age_kpi_summary": figures(
        {"avg_age": "round(avg(age), 1)"}
        | {
            name: hits(f"age_band = '{band}'")
            for name, band in [
                ("age_15_18", "15-18"),
                ("age_19_29", "19-29"),
                ("age_30_39", "30-39"),
                ("age_40_49", "40-49"),
                ("age_50_plus", "50+"),
            ]
        },
        STAFF,
    ),
    "age_distribution": grouped("coalesce(age_band, 'Bilinmiyor') AS age_group", "age_band"),
    "age_company_heatmap": grouped(
        "company, coalesce(age_band, 'Diğer') AS age_group", "company, age_band"
    ),
    "age_department_location": grouped(
        "location, department, coalesce(age_band, 'Bilinmiyor') AS age_group",
        "location, department, age_band",
        order="location, department, age_band DESC NULLS FIRST",
        limit=1000,
    ),
    "age_location_gender": grouped(
        "location, gender, coalesce(age_band, 'Bilinmiyor') AS age_group",
        "location, gender, age_band",
        order="location, age_band NULLS LAST, gender",
        limit=1000,
    ),
    "age_position_gender": grouped(
        "coalesce(position, 'POZİSYON BİLGİSİ BOŞ') AS position, "
        "coalesce(age_band, 'Bilinmiyor') AS age_group, gender",
        "1, age_band, gender",
        order="1, age_band DESC NULLS FIRST, gender",
        limit=100000,
    ),
}

BLOOD = {
    "blood_kpi_summary": figures(
        {"total": "count(emp_id)"}
        | {
            name: hits(f"blood_type = '{group}'")
            for name, group in [
                ("a_pos", "A+"),
                ("b_pos", "B+"),
                ("ab_pos", "AB+"),
                ("o_pos", "O+"),
                ("a_neg", "A-"),
                ("b_neg", "B-"),
                ("ab_neg", "AB-"),
                ("o_neg", "O-"),
            ]
        }
        | {"unknown": hits(f"blood_type IS NULL OR blood_type = '{NO_INFO}'")},
        STAFF,
    ),
    "blood_distribution": grouped("coalesce(blood_type, 'Bilinmiyor') AS blood_type", "personnel.blood_type"),
    "blood_gender_dist": plain("gender"),
    "blood_age_dist": grouped(
        "blood_type, coalesce(age_band, 'Bilinmiyor') AS age_group",
        "1, 2",
        f"{STAFF} AND trim(blood_type) <> '{NO_INFO}'",
    ),
    "blood_company_heatmap": grouped(
        "company, coalesce(blood_type, 'Bilinmiyor') AS blood_type", "1, 2"
    ),
    "blood_table_details": grouped(
        "company, location, coalesce(personnel.blood_type, 'Bilinmiyor') AS blood_type, gender",
        "company, location, personnel.blood_type, gender",
        order="count(emp_id) DESC, company, location, personnel.blood_type NULLS LAST, gender",
        limit=1000,
    ),
}

LOCATION = {
    "location_map_residence": grouped(
        "coalesce(map{'ADANA': 'TR-01', 'ADIYAMAN': 'TR-02', 'ANKARA': 'TR-06', "
        "'ANTALYA': 'TR-07', 'BURSA': 'TR-16', 'İSTANBUL': 'TR-34', 'İZMİR': 'TR-35', "
        "'KOCAELİ': 'TR-41'}[residence_city], concat('TR-', left(residence_city, 2))) AS code, "
        "residence_city AS province",
        "residence_city HAVING count(emp_id) > 0",
    ),
    "location_map_duty": grouped(
        "coalesce(map{'ADANA': 'TR-01', 'ANKARA': 'TR-06', 'İSTANBUL': 'TR-34', "
        "'İZMİR': 'TR-35'}[duty_city], duty_city) AS code, duty_city AS province",
        "duty_city HAVING count(emp_id) > 0",
    ),
    "location_residence_dist": grouped(
        "coalesce(residence_city, 'Bilinmiyor') AS province",
        "residence_city",
        order="count(emp_id) DESC, residence_city NULLS LAST",
        limit=100,
    ),
    "location_residence_company": grouped(
        "company, location, department, residence_city AS province",
        "1, 2, 3, 4",
        order="count DESC, 1, 2, 3, 4 NULLS LAST",
        limit=1000,
    ),
    "location_duty_dist": grouped("coalesce(duty_city, 'Bilinmiyor') AS city", "duty_city"),
    "location_duty_company": grouped(
        "company, location, department, duty_city AS city",
        "1, 2, 3, 4",
        order="count DESC, 1, 2, 3, 4 NULLS LAST",
        limit=1000,
    ),
    "location_employee_list": over(["personnel"])
    + "SELECT company, full_name AS name, location, department, position, duty_city, "
    f"residence_city, district FROM personnel WHERE {STAFF} "
    "ORDER BY 1, 2, 3, 4, 5 NULLS LAST, 6 NULLS LAST, 7 NULLS LAST, 8 LIMIT 5000",
}

ENGAGEMENT = {
    "engagement_kpi_summary": durations("", ""),
    "engagement_by_location": durations("location", "location", 100),
    "engagement_by_department": durations("department", "department", 100),
    "engagement_by_marital": durations("marital_status AS status", "marital_status"),
    "engagement_by_age_group": durations("age_band AS age_group", "age_band"),
    "engagement_by_education": durations("education", "education"),
    "engagement_details": over(["engagement"])
    + "SELECT company, location, dept_code, full_name AS name, position, gender, age, "
    "marital_status AS status, education, work_duration, leave_duration FROM engagement "
    "WHERE org_ref = '1' ORDER BY work_duration DESC NULLS FIRST, company, location, dept_code, "
    "name, position NULLS LAST, gender, age NULLS LAST, status NULLS LAST, education NULLS LAST, "
    "leave_duration NULLS LAST LIMIT 5000",
}

TIMELINE = (
    over(["personnel_month"])
    + f"SELECT year_month, {hits('is_hire = 1')} AS hires, {hits('is_leaver = 1')} AS leavers, "
    f"{hits('left_unit = 1 AND is_leaver = 0')} AS transfers "
    "FROM personnel_month WHERE org_ref = '1' GROUP BY year_month"
)

MOVEMENTS = {
    "turnover_timeline": TIMELINE,
    "turnover_timeline_kept": TIMELINE,
    "turnover_details": over(["personnel_month"])
    + "SELECT year_month AS period, company, location, full_name AS name, "
    "if(is_hire = 1, 'İşe Giriş', 'İşten Çıkış') AS movement_type, position, education "
    "FROM personnel_month WHERE org_ref = '1' AND 1 IN (is_hire, is_leaver) "
    "ORDER BY period DESC, company, location, name, movement_type, position NULLS LAST, "
    "education NULLS LAST LIMIT 1000",
}

FAMILY = {
    "family_kpi_summary": figures(
        {
            "total_employees": "count(emp_id)",
            "has_children": hits("child_flag = '1'"),
            "no_children": hits("child_flag = '0'"),
        },
        STAFF,
    ),
    "family_marital_dist": grouped(
        "marital_status AS status", "1", f"{STAFF} AND marital_status IN ('EVLİ', 'BEKAR')"
    ),
    "family_gender_marital": grouped(
        "gender, marital_status AS status",
        "1, 2",
        f"{STAFF} AND marital_status IN ('EVLİ', 'BEKAR')",
    ),
    "family_gender_children": grouped(
        "gender, CASE child_flag WHEN '1' THEN 'Çocuk Var' WHEN '0' THEN 'Çocuk Yok' "
        "ELSE 'Bilinmiyor' END AS child_status",
        "1, 2",
    ),
}

INTERNS = {
    "intern_kpi_summary": figures(
        {
            "intern_count": hits("staff_type = 'Stajyer'"),
            "apprentice_count": hits("staff_type = 'Çırak'"),
            "total_students": "count(emp_id)",
        },
        STUDENTS,
    ),
    "intern_details": grouped(
        "location, department, staff_type AS type, gender, "
        "coalesce(personnel.blood_type, '-') AS blood_type, age_band AS age_group, "
        "coalesce(personnel.education, '-') AS education",
        "location, department, staff_type, gender, personnel.blood_type, age_band, "
        "personnel.education",
        STUDENTS,
        "count(emp_id) DESC, location, department, staff_type, gender, "
        "personnel.blood_type NULLS LAST, age_band NULLS LAST, personnel.education NULLS LAST",
        1000,
    ),
}


def _measure(part: int, low: int, high: int, scale: int, name: str) -> str:
    """A row's random number: ten hex digits of the digest of seed and employee id."""
    digits = f"substr(md5('42:' || emp_id), {1 + part * 10}, 10)"
    unit = f"CAST(CAST('0x' || {digits} AS BIGINT) AS DOUBLE) / 1099511627776"
    return f"round({unit} * {high - low} + {low}, {scale}) AS {name}"


DUMP = (
    over(["personnel"])
    + "SELECT *, "
    + ", ".join(
        [
            _measure(0, 1, 20, 2, "work_duration_years"),
            _measure(1, 0, 5, 1, "leave_duration_years"),
            _measure(2, 10, 100, 0, "performance_score"),
        ]
    )
    + f" FROM personnel WHERE {STAFF}"
)
DATASETS = {"dataset_full": DUMP + " ORDER BY emp_id LIMIT 2000", "dataset_heavy": DUMP}

TWINS = (
    EMPLOYEES
    | EDUCATION
    | AGE
    | BLOOD
    | LOCATION
    | ENGAGEMENT
    | MOVEMENTS
    | FAMILY
    | INTERNS
    | DATASETS
)
