"""Column helpers."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crewlytics.functions import dates, numbers, text


@pytest.fixture(scope="module")
def value(spark):
    """The result of one expression over literals."""

    def evaluate(column):
        return spark.range(1).select(column.alias("v")).first().v

    return evaluate


def test_joined_treats_null_as_empty(value):
    assert value(text.joined(F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert value(text.joined(F.lit(7), F.lit("x"))) == "7x"


def test_upper_is_plain_unless_turkish_is_asked_for(value):
    assert value(text.upper_text(F.lit("ılık izmir"))) == "ILIK IZMIR"
    assert value(text.upper_text(F.lit("ılık izmir"), turkish=True)) == "ILIK İZMİR"


@pytest.mark.parametrize(
    ("cell", "is_known", "is_missing"),
    [(None, False, True), ("-", False, True), (" - ", True, False), ("x", True, False)],
)
def test_known_and_missing(value, cell, is_known, is_missing):
    column = F.lit(cell).cast("string")
    assert value(F.coalesce(text.known(column, "-"), F.lit(False))) is is_known
    assert value(text.missing(column, "-")) is is_missing
    if cell == " - ":
        assert value(text.known(column, "-", trim=True)) is False


def test_contains_ignores_case(value):
    assert value(text.contains_ci(F.lit("Üretim Müdürlüğü"), "üretİm")) is False
    assert value(text.contains_ci(F.lit("ÜRETIM"), "üretim")) is True


def test_percent_and_ratio(value):
    assert value(numbers.percent(F.lit(1), F.lit(3))) == 33.3
    assert value(numbers.percent(F.lit(1), F.lit(0))) is None
    assert value(numbers.ratio(F.lit(1), F.lit(8))) == 0.125


def test_rounding_goes_away_from_zero(value):
    assert [value(F.round(F.lit(x), 2)) for x in (2.675, -2.675)] == [2.68, -2.68]


def test_training_hours(value):
    hours = {u: value(numbers.training_hours(F.lit(3), F.lit(u))) for u in ("Day", "Hour", "Week")}
    assert hours == {"Day": 24.0, "Hour": 3.0, "Week": None}
    assert value(numbers.training_hours(F.lit(3), F.lit(None).cast("string"))) is None


def test_dates(value):
    day = dt.date(2000, 1, 31)
    assert value(dates.month_key(F.lit(day))) == "2000-01"
    assert value(dates.days_before(day, 31)) == dt.date(1999, 12, 31)
    assert value(dates.open_ended(F.lit(None).cast("date"))) == dt.date(2999, 12, 31)
    assert value(dates.day_of(F.lit(dt.datetime(2000, 1, 31, 23, 59)))) == day
    assert value(dates.covers(F.lit(day), F.lit(day), F.lit(day))) is True
    assert value(dates.covers(F.lit(day), F.lit(None).cast("date"), F.lit(day))) is None
    assert value(dates.running_at(F.lit(day), F.lit(day), day)) is False
    assert value(dates.running_at(F.lit(day), F.lit(None).cast("date"), day)) is True


def test_tune_leaves_a_chosen_setting_alone(spark):
    from crewlytics.sources.session import JVM_LIMIT, METHOD_LIMIT, SPARK_DEFAULT, tune

    before = spark.conf.get(METHOD_LIMIT)
    try:
        spark.conf.set(METHOD_LIMIT, SPARK_DEFAULT)
        assert tune(spark).conf.get(METHOD_LIMIT) == JVM_LIMIT
        spark.conf.set(METHOD_LIMIT, "9000")
        assert tune(spark).conf.get(METHOD_LIMIT) == "9000"
    finally:
        spark.conf.set(METHOD_LIMIT, before)
