"""The interaction log: an append-only table in day folders, with expiry on reading.

``log_upkeep`` deletes what has expired and folds small files.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from crewlytics.functions import fixed_values as fv
from crewlytics.sources.log_upkeep import finish_swaps
from crewlytics.sources.schemas import checked, view_schema


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("ts"))


def interaction(
    question: str,
    generated_sql: str | None,
    success: bool,
    at: dt.datetime,
    row_count: int = 0,
    error: object = None,
) -> dict:
    """One record of the log."""
    return {
        "ts": at,
        "question": question,
        "generated_sql": generated_sql,
        "success": success,
        "row_count": row_count,
        "error_details": str(error) if error else None,
        "app_version": fv.APP_VERSION,
    }


def records(spark: SparkSession, interactions: list[dict]) -> DataFrame:
    """Records a service has gathered, ready to be appended together."""
    schema = view_schema("interactions")
    return spark.createDataFrame([[r[n] for n in schema.names] for r in interactions], schema)


def append_interactions(df: DataFrame, path: str) -> None:
    """Adds records to the log.

    The rebalance hint keeps files large: small days share a writer, a day that holds
    much of the data is split over several.
    """
    rows = with_day(checked(df, "interactions")).hint("rebalance", "day")
    rows.write.mode("append").partitionBy("day").parquet(path)


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """The whole log; swaps of files that a crash has interrupted are finished first."""
    finish_swaps(spark, path)
    return spark.read.schema(view_schema("interactions").add("day", "date")).parquet(path)


def retain(
    df: DataFrame, as_of: dt.datetime, seconds: int = fv.RETENTION_SECONDS, ts: str = "ts"
) -> DataFrame:
    """Records that have not expired at ``as_of``.

    On a table in day folders the day condition skips expired folders unread.
    """
    oldest = as_of - dt.timedelta(seconds=seconds)
    kept = df.where(F.col(ts) > F.lit(oldest).cast("timestamp_ntz"))
    return kept.where(F.col("day") >= F.lit(oldest.date())) if "day" in df.columns else kept
