"""The interaction log, its stream, its expiry, and the clean-up of logged SQL."""

from __future__ import annotations

import datetime as dt
import os
import re
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from frames import DATA, rows_of
from pyspark.sql.pandas.types import to_arrow_schema

from crewlytics.operators.quality import fk_orphans, key_violations
from crewlytics.operators.query_log import normalise_queries
from crewlytics.sources import log_upkeep
from crewlytics.sources.interaction_log import (
    append_interactions,
    interaction,
    read_interactions,
    records,
    retain,
)
from crewlytics.sources.schemas import view_schema
from crewlytics.streaming.interactions import event_stream, interactions_stream

AS_OF = dt.datetime(2024, 2, 5)


def run_stream(spark, source, folder):
    query = interactions_stream(event_stream(spark, source, 1), f"{folder}/log", f"{folder}/ck")
    query.awaitTermination()
    return read_interactions(spark, f"{folder}/log").drop("day")


def test_stream_equals_batch_and_does_not_repeat(spark, workforce, tmp_path):
    expected = rows_of(workforce.interactions)
    assert rows_of(run_stream(spark, DATA, tmp_path)) == expected
    assert rows_of(run_stream(spark, DATA, tmp_path)) == expected


def test_stream_takes_up_new_files(spark, workforce, tmp_path):
    source = tmp_path / "source"
    (source / "events.parquet").mkdir(parents=True)
    file = os.path.join(DATA, "events.parquet")
    shutil.copy(file, source / "events.parquet" / "one.parquet")
    once = run_stream(spark, str(source), tmp_path / "run").count()
    shutil.copy(file, source / "events.parquet" / "two.parquet")
    assert run_stream(spark, str(source), tmp_path / "run").count() == 2 * once


def test_append_keeps_what_is_there(spark, workforce, tmp_path):
    path = str(tmp_path / "log")
    append_interactions(workforce.interactions, path)
    append_interactions(workforce.interactions, path)
    stored = read_interactions(spark, path)
    assert stored.count() == 2 * workforce.interactions.count()
    assert any(name.startswith("day=2024-01-") for name in os.listdir(path))


def test_records_of_a_service(spark, tmp_path):
    at = dt.datetime(2024, 2, 5, 10, 30)
    made = [
        interaction("q1", "SELECT 1", True, at, row_count=1),
        interaction("q2", None, False, at, error=ValueError("bad")),
    ]
    append_interactions(records(spark, made), str(tmp_path / "log"))
    stored = read_interactions(spark, str(tmp_path / "log")).drop("day")
    assert rows_of(stored) == sorted(
        [
            (at, "q1", "SELECT 1", True, 1, None, "1.0.0"),
            (at, "q2", None, False, 0, "bad", "1.0.0"),
        ],
        key=repr,
    )


def test_expired_days_are_not_read(spark, workforce, tmp_path):
    path = str(tmp_path / "log")
    append_interactions(workforce.interactions, path)
    kept = retain(read_interactions(spark, path), AS_OF)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day[^\]]*2024-01-06", plan)
    assert rows_of(kept.drop("day")) == rows_of(retain(workforce.interactions, AS_OF))


def test_expiry_is_exact(spark):
    moments = [dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 6, 0, 0, 1)]
    rows = spark.createDataFrame([(m,) for m in moments], "ts timestamp_ntz")
    assert [r.ts for r in retain(rows, AS_OF).collect()] == moments[1:]
    assert retain(rows, AS_OF, seconds=10).count() == 0


@pytest.mark.parametrize(
    ("text", "clean", "write"),
    [
        ("SELECT a FROM t LIMIT 10;", "SELECT a FROM t FETCH FIRST 10 ROWS ONLY", False),
        ("select top 5 a from t", "SELECT a from t", False),
        ("SELECT TOP  7\n a FROM t limit\t3", "SELECT a FROM t FETCH FIRST 3 ROWS ONLY", False),
        ("SELECT\tTOP\t5 a FROM t", "SELECT\tTOP\t5 a FROM t", False),
        ("SELECT TOP 5 a FROM (SELECT TOP 2 a FROM t)", "SELECT a FROM (SELECT a FROM t)", False),
        ('  SELECT "a" FROM "t" ; ', "SELECT a FROM t", False),
        ("```sql\nSELECT 1\n```", "\nSELECT 1\n", False),
        ("```SELECT 1```", "SELECT 1", False),
        ("\n delete from t", "delete from t", True),
        ("```sql\nDROP TABLE t```", "\nDROP TABLE t", True),
        ("WITH x AS (SELECT 1) SELECT * FROM x", "WITH x AS (SELECT 1) SELECT * FROM x", False),
        ("LIMIT ٣", "FETCH FIRST ٣ ROWS ONLY", False),
        ("", "", False),
        (None, None, False),
    ],
)
def test_query_clean_up(spark, text, clean, write):
    df = spark.createDataFrame([(text,)], "generated_sql string")
    row = normalise_queries(df).first()
    assert (row.clean_sql, row.is_write) == (clean, write)


def test_key_violations(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3), (2, None)], "a int, b int")
    found = rows_of(key_violations(df, ["a", "b"]))
    assert found == sorted([(1, 1, 2), (None, 3, 1), (2, None, 1)], key=repr)


def test_orphans_ignore_incomplete_keys(spark):
    child = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (None, 9), (3, None)], "a int, b int")
    parent = spark.createDataFrame([(1, 1), (None, 9)], "x int, y int")
    assert rows_of(fk_orphans(child, parent, {"a": "x", "b": "y"})) == [(1, 2, 2)]


def test_stream_writes_few_files_per_day(spark, tmp_path):
    run_stream(spark, DATA, tmp_path)
    days = [d for d in os.listdir(tmp_path / "log") if d.startswith("day=")]
    assert days
    for day in days:
        files = [f for f in os.listdir(tmp_path / "log" / day) if f.endswith(".parquet")]
        assert 1 <= len(files) <= 4


class Crash(Exception):
    pass


def test_folding_a_thousand_files_of_a_day(spark, tmp_path):
    path = tmp_path / "log"
    day = path / "day=2024-01-20"
    day.mkdir(parents=True)
    at, schema = dt.datetime(2024, 1, 20, 12), to_arrow_schema(view_schema("interactions"))
    for i in range(1000):
        row = interaction(f"question {i}", "SELECT 1", True, at + dt.timedelta(seconds=i % 7), i)
        pq.write_table(pa.Table.from_pylist([row], schema), day / f"{i}.parquet")
    before = rows_of(read_interactions(spark, str(path)))
    assert log_upkeep.fold_files(spark, str(path), dt.date(2024, 1, 20)) == []
    assert log_upkeep.fold_files(spark, str(path), dt.date(2024, 2, 1)) == ["day=2024-01-20"]
    assert rows_of(read_interactions(spark, str(path))) == before and len(before) == 1000
    assert len([n for n in os.listdir(day) if n.endswith(".parquet")]) == 1
    assert log_upkeep.fold_files(spark, str(path), dt.date(2024, 2, 1)) == []


def test_expiry_deletes(spark, workforce, tmp_path):
    path = str(tmp_path / "log")
    append_interactions(workforce.interactions, path)
    kept = rows_of(retain(read_interactions(spark, path), AS_OF))
    for _ in range(2):
        log_upkeep.expire(spark, path, AS_OF)
        assert rows_of(read_interactions(spark, path)) == kept
    assert min(n for n in os.listdir(path) if n.startswith("day=")) == "day=2024-01-06"


@pytest.mark.parametrize("step", ["mark", "move", "delete"])
@pytest.mark.parametrize("nth", [1, 2, 3, 5])
def test_a_crash_at_any_step_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, step, nth):
    path = str(tmp_path / "log")
    rows = [
        interaction(f"q{i}", None, True, dt.datetime(2024, 1, 6 + i % 2, i % 24), i) for i in range(48)
    ]
    for n in range(3):
        append_interactions(records(spark, rows[n::3]), path)
    before = rows_of(read_interactions(spark, path))
    real, calls = getattr(log_upkeep._Folder, step), []

    def failing(self, *args):
        calls.append(args)
        if len(calls) == nth:
            raise Crash
        return real(self, *args)

    with monkeypatch.context() as broken:
        broken.setattr(log_upkeep._Folder, step, failing)
        try:
            log_upkeep.fold_files(spark, path, dt.date(2024, 2, 1), few=0)
        except Crash:
            pass
    assert rows_of(read_interactions(spark, path)) == before
    log_upkeep.fold_files(spark, path, dt.date(2024, 2, 1), few=0)
    log_upkeep.expire(spark, path, AS_OF)
    oldest = AS_OF - dt.timedelta(days=30)
    assert rows_of(read_interactions(spark, path)) == [r for r in before if r[0] > oldest]
