"""Interactions appended to the log as they happen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from crewlytics.sources.base_tables import BASE_SCHEMAS, base_path
from crewlytics.sources.derived import log_records
from crewlytics.sources.interaction_log import read_interactions, with_day
from crewlytics.sources.scratch import shared_folder


def event_stream(
    spark: SparkSession, directory: str, files_per_batch: int = 1000
) -> DataFrame:
    """The event table as a stream of its files, known or still arriving.

    The path is a pattern because a stream takes a single file only that way; it fits a
    folder of files just as well.
    """
    reader = spark.readStream.schema(BASE_SCHEMAS["events"])
    reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(base_path(directory, "{events}"))


def interactions_stream(
    events: DataFrame, sink: str, checkpoint: str, files_per_day: int = 4
) -> StreamingQuery:
    """Appends what has arrived and stops; started again, it takes up where it ended.

    A batch writes at most ``files_per_day`` files for a day; a day that holds much of the
    batch is shared by as many tasks.  The checkpoint remembers the files already taken and the sink the batches already
    written, so a batch repeated after a failure is not stored twice.
    """
    rows = with_day(log_records(events))
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(files_per_day))
    return (
        rows.repartition("day", spread)
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("day")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_to_log(spark: SparkSession, directory: str) -> DataFrame:
    """Runs the stream over what is there and returns the stored log."""
    folder = shared_folder(spark, "interactions")
    query = interactions_stream(
        event_stream(spark, directory), f"{folder}/log", f"{folder}/checkpoint"
    )
    query.awaitTermination()
    return read_interactions(spark, f"{folder}/log").drop("day")
