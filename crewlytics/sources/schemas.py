"""Declared schemas of the workforce views, checked when a stored table is loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

VIEW_SCHEMAS = {
    "personnel": (
        "emp_id bigint, full_name string, company string, location string, department string, "
        "dept_code string, position string, position_title string, org_ref string, "
        "is_active int, is_regular int, staff_type string, is_hire int, is_leaver int, "
        "gender string, is_disabled int, disability_degree string, age int, age_band string, "
        "education string, education_level string, blood_type string, marital_status string, "
        "child_flag string, staff_group string, employment_status string, duty_place string, "
        "residence_city string, duty_city string, district string"
    ),
    "personnel_month": (
        "year_month string, org_ref string, company string, location string, full_name string, "
        "position string, education string, is_hire int, is_leaver int, left_unit int"
    ),
    "engagement": (
        "org_ref string, company string, location string, department string, dept_code string, "
        "full_name string, position string, gender string, age int, age_band string, "
        "marital_status string, education string, work_duration decimal(10,2), "
        "leave_duration decimal(10,2)"
    ),
    "training_event": (
        "training_event_id bigint, training_event_name string, company_id string, "
        "start_date date, end_date date, training_duration decimal(10,2), "
        "training_duration_unit string"
    ),
    "training_participant": (
        "training_event_id bigint, participant_id bigint, participant_type string, "
        "participant_name string, cancel_date date"
    ),
    "training_participant_qry": "participant_id bigint",
    "training_event_course": "training_event_id bigint, course_id bigint",
    "course": "course_id bigint, course_title string, course_category_id string",
    "course_category": "course_category_id string, category_name string",
    "company_pers_assign": (
        "emp_no bigint, company_id string, org_code string, pos_code string, valid_from date, "
        "valid_to date, is_primary int"
    ),
    "work_spell": (
        "emp_no bigint, company_id string, seq_no int, site_code string, start_date date, "
        "end_date date"
    ),
    "position_dim": "company_id string, pos_code string, position_title string",
    "org_dim": "company_id string, org_code string, org_name string",
    "staff_group_dim": "company_id string, site_code string, group_name string",
    "interactions": (
        "ts timestamp_ntz, question string, generated_sql string, success boolean, "
        "row_count int, error_details string, app_version string"
    ),
    "product": (
        "id bigint, category string, name string, price decimal(10,2), stock bigint"
    ),
    "sale": (
        "id bigint, product_id bigint, quantity bigint, total decimal(10,2), "
        "sold_at timestamp_ntz, city string"
    ),
}


def view_schema(name: str) -> StructType:
    return StructType.fromDDL(VIEW_SCHEMAS[name])


def checked(df: DataFrame, name: str) -> DataFrame:
    """The declared columns of a view, in order; a missing or mistyped one is an error."""
    found = {field.name: field.dataType for field in df.schema}
    problems = []
    for field in view_schema(name):
        if field.name not in found:
            problems.append(f"{field.name} is missing")
        elif found[field.name] != field.dataType:
            problems.append(
                f"{field.name} is {found[field.name].simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    if problems:
        raise ValueError(f"view {name}: " + "; ".join(problems))
    return df.select(*view_schema(name).fieldNames())


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty text becomes NULL, the meaning it has in the source database."""
    return df.select(
        *[
            F.nullif(F.col(f.name), F.lit("")).alias(f.name)
            if isinstance(f.dataType, StringType)
            else F.col(f.name)
            for f in df.schema
        ]
    )
