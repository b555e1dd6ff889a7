from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DateType, DecimalType

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from frames import DATA  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("crewlytics-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def workforce(spark):
    from crewlytics.sources.workforce import Workforce

    return Workforce.derived(spark, DATA)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        if name.endswith(".parquet"):
            path = os.path.join(DATA, name)
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def make(spark):
    """Rows of a view given as dicts, dates as text; the columns left out are NULL."""
    from crewlytics.sources.schemas import view_schema

    def typed(value, kind):
        if value is None:
            return None
        if isinstance(kind, DecimalType):
            return Decimal(str(value))
        if isinstance(kind, DateType):
            return dt.date.fromisoformat(value)
        return value

    def build(view: str, rows: list[dict]):
        schema = view_schema(view)
        for row in rows:
            unknown = set(row) - set(schema.names)
            assert not unknown, unknown
        values = [{f.name: typed(row.get(f.name), f.dataType) for f in schema} for row in rows]
        table = pa.Table.from_pylist(values, schema=to_arrow_schema(schema))
        return spark.createDataFrame(table, schema)

    return build


@pytest.fixture(scope="session")
def given(spark, make):
    """A workforce of hand-made tables; tables left out are empty."""
    from crewlytics.sources.workforce import Workforce

    def build(**tables: list[dict]):
        return Workforce(spark, lambda name: make(name, tables.get(name, [])))

    return build
