"""Every query must return what its SQL twin returns."""

from __future__ import annotations

import math

import pytest
from frames import DATA

import __spark_entry__ as entry_points

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
    "decimal(10,2)": "DECIMAL(10,2)",
}


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "NULL" if value is None else str(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


REPORTS = entry_points.catalogue.reports() | entry_points.catalogue.directory_reports()


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_query_agrees_with_its_twin(name, spark, duck):
    df = entry_points.queries()[name](spark, DATA)
    found = df.collect()
    cursor = duck.execute(entry_points.oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    types = {column[0]: str(column[1]) for column in cursor.description}
    expected = cursor.fetchall()
    assert len(set(df.columns)) == len(df.columns)
    assert sorted(df.columns) == sorted(columns)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    assert _table(df.columns, found) == _table(columns, expected)


def test_every_query_has_a_twin():
    assert set(REPORTS) == set(entry_points.catalogue.twins())
    assert set(REPORTS) <= set(entry_points.queries())


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() == 1
