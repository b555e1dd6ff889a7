"""Stored, catalogued and ad-hoc tables."""

from __future__ import annotations

import pytest
from frames import rows_of
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from crewlytics.plans import employees, engagement
from crewlytics.sources.schemas import VIEW_SCHEMAS, blank_to_null, checked, view_schema
from crewlytics.sources.scratch import shared_folder
from crewlytics.sources.workforce import (
    Workforce,
    jdbc_options,
    named_tables,
    register_views,
    run_select,
    write_views,
)

SMALL = ["personnel", "engagement", "work_spell", "interactions"]


@pytest.mark.parametrize("name", sorted(VIEW_SCHEMAS))
def test_derived_views_have_the_declared_schema(workforce, name):
    df = getattr(workforce, name)
    assert checked(df, name).columns == view_schema(name).names


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_stored_views_read_back(spark, workforce, tmp_path, fmt):
    write_views(workforce, str(tmp_path), SMALL, fmt)
    stored = Workforce.stored(spark, str(tmp_path), fmt)
    for name in SMALL:
        assert rows_of(getattr(stored, name)) == rows_of(getattr(workforce, name)), name
    assert rows_of(engagement.engagement_by_location(stored)) == rows_of(
        engagement.engagement_by_location(workforce)
    )


def test_catalog_tables(spark, workforce):
    spark.sql("CREATE DATABASE IF NOT EXISTS staffing")
    workforce.personnel.write.mode("overwrite").saveAsTable("staffing.personnel")
    catalogued = Workforce.catalog(spark, "staffing")
    report = employees.employees_dist_company
    assert rows_of(report(catalogued)) == rows_of(report(workforce))


def test_wrong_schema_is_an_error(spark):
    with pytest.raises(ValueError, match="course_title is missing"):
        checked(spark.range(1).withColumnRenamed("id", "course_id"), "course")
    wrong = spark.createDataFrame(
        [(1, "t", "c")], "course_id int, course_title string, course_category_id string"
    )
    with pytest.raises(ValueError, match="course_id is int, expected bigint"):
        checked(wrong, "course")


def test_blank_text_becomes_null(spark):
    rows = spark.createDataFrame([("", 1), (" ", 2), ("x", 3)], "t string, n int")
    assert rows_of(blank_to_null(rows)) == rows_of(
        spark.createDataFrame([(None, 1), (" ", 2), ("x", 3)], "t string, n int")
    )


def test_unknown_table(workforce):
    with pytest.raises(AttributeError):
        workforce.payroll


def test_sql_over_the_views(spark, workforce):
    register_views(workforce, ["personnel"])
    counted = spark.sql("SELECT count(*) AS n FROM personnel").first().n
    assert counted == workforce.personnel.count()
    found = run_select(workforce, "SELECT company, count(emp_id) AS n FROM personnel GROUP BY company;")
    assert rows_of(found) == rows_of(
        workforce.personnel.groupBy("company").agg(F.count("emp_id").alias("n"))
    )


@pytest.mark.parametrize(
    "text",
    ["DROP VIEW personnel", "INSERT INTO personnel SELECT 1", "CREATE TABLE t (a int)"],
)
def test_only_queries_run(workforce, text):
    with pytest.raises(ParseException):
        run_select(workforce, text)


NAMED = [
    ("SELECT 'from sale' AS a, \"x from sale\" AS b FROM product", ["product"]),
    ("SELECT * FROM Product -- join sale on true", ["product"]),
    ("SELECT /* from sale */ course FROM product sale", ["product"]),
    ("SELECT sale.id FROM product AS sale, engagement", ["engagement", "product"]),
    ("SELECT id FROM hr.sale JOIN `product` USING (id)", ["product"]),
    ("WITH a AS (SELECT * FROM sale) SELECT * FROM a", ["a", "sale"]),
    ("SELECT (SELECT max(id) FROM sale) FROM product WHERE id IN (SELECT id FROM course)", ["course", "product", "sale"]),
    ("SELECT id FROM product UNION ALL (SELECT id FROM sale MINUS SELECT 1)", ["product", "sale"]),
    ("SELECT " + ", ".join(f"(SELECT max(id) FROM t{i}) AS c{i}" for i in range(40)), sorted(f"t{i}" for i in range(40))),
    ("SELECT 1", []),
]


@pytest.mark.parametrize(("text", "tables"), NAMED)
def test_tables_are_those_the_parser_reads(spark, text, tables):
    assert named_tables(spark, text) == tables


def temporary(spark):
    return {t.name for t in spark.catalog.listTables() if t.isTemporary}


def test_views_of_a_select_do_not_stay(spark, workforce):
    spark.range(3).createOrReplaceTempView("course")
    before = temporary(spark)
    found = run_select(workforce, "SELECT count(*) AS n FROM course JOIN product ON true WHERE course_id = id")
    assert temporary(spark) == before
    assert spark.table("course").columns == ["id"]
    joined = workforce.course.join(workforce.product, F.col("course_id") == F.col("id"))
    assert found.first().n == joined.count()
    with pytest.raises(AnalysisException):
        run_select(workforce, "SELECT nothing FROM sale")
    assert temporary(spark) == before
    spark.catalog.dropTempView("course")


def test_a_view_may_be_redefined_by_its_select(spark, workforce):
    found = run_select(workforce, "WITH product AS (SELECT id FROM product WHERE id < 3) SELECT * FROM product")
    assert rows_of(found) == rows_of(workforce.product.where("id < 3").select("id"))


def test_jdbc_reads_are_spread_over_a_column():
    options = jdbc_options("jdbc:x", "hr.people", ("emp_id", 1, 9, 4), {"user": "u"})
    assert options["dbtable"] == "hr.people" and options["user"] == "u"
    assert options["partitionColumn"] == "emp_id" and options["numPartitions"] == "4"
    assert "partitionColumn" not in jdbc_options("jdbc:x", "t", None, None)


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "a"), shared_folder(spark, "a")
    assert first.startswith(root) and first != second
