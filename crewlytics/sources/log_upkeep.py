"""Keeping the stored interaction log small: expiry that deletes, and folding of small files.

Both replace files of day folders. The new files of a day are written beside the log, then renamed
as a folder below ``_ready`` together with the names of the files they stand for: that rename is the
point from which the new files count. What follows, deleting the old files and moving the new ones
in, can be repeated any number of times; ``finish_swaps`` does what a crash has left undone, and
readers call it first. Old files go before new ones come, so no reader sees a record twice, and
files that arrive meanwhile are not touched. One upkeep job of a log runs at a time.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crewlytics.functions import fixed_values as fv
from crewlytics.sources.folders import Folder as _Folder
from crewlytics.sources.schemas import view_schema

READY, STAGED, OLD = "_ready", "_staged", "_old"
FILE_BYTES = 128 << 20


def finish_swaps(spark: SparkSession, path: str) -> None:
    """Brings in the new files of days whose swap has begun; without any it only lists a folder."""
    folder = _Folder(spark, path)
    for day in folder.entries(READY):
        for name in folder.entries(READY, day, OLD):
            folder.delete(day, name)
        for name in folder.data_files(READY, day):
            folder.move([READY, day, name], [day, name])
        folder.delete(READY, day)


def _rewrite(
    spark: SparkSession, path: str, files: dict[str, dict[str, int]], file_bytes: int, kept: Column | None = None
) -> None:
    """Writes the rows of the given files of some days into files of about ``file_bytes``."""
    folder = _Folder(spark, path)
    names = [f"{path.rstrip('/')}/{day}/{name}" for day, held in files.items() for name in held]
    rows = spark.read.schema(view_schema("interactions").add("day", "date")).option("basePath", path).parquet(*names)
    if kept is not None:
        rows = rows.where(kept)
    parts = [(day.partition("=")[2], max(1, -(-sum(held.values()) // file_bytes))) for day, held in files.items()]
    many = F.create_map(*[F.lit(x) for pair in parts for x in pair])[F.col("day").cast("string")]
    dealt = F.pmod(F.xxhash64(*view_schema("interactions").names), many)
    stage = f"{STAGED}-{uuid.uuid4().hex}"
    rows.repartition("day", dealt).write.partitionBy("day").parquet(f"{path.rstrip('/')}/{stage}")
    for day, held in files.items():
        for name in held:
            folder.mark(stage, day, OLD, name)
        folder.move([stage, day], [READY, day])
    folder.delete(stage)
    finish_swaps(spark, path)


def expire(
    spark: SparkSession, path: str, as_of: dt.datetime, seconds: int = fv.RETENTION_SECONDS
) -> None:
    """Deletes the records that have expired at ``as_of``.

    Folders of days that have passed whole are deleted unread; the day in which the limit lies is
    written anew without its expired records. Repeating it changes nothing more.
    """
    finish_swaps(spark, path)
    folder = _Folder(spark, path)
    oldest = as_of - dt.timedelta(seconds=seconds)
    for day in folder.days():
        if day < f"day={oldest.date()}":
            folder.delete(day)
    bound = f"day={oldest.date()}"
    held = folder.data_files(bound)
    if held:
        _rewrite(spark, path, {bound: held}, FILE_BYTES, F.col("ts") > F.lit(oldest).cast("timestamp_ntz"))


def fold_files(
    spark: SparkSession, path: str, before: dt.date, file_bytes: int = FILE_BYTES, few: int = 2
) -> list[str]:
    """Folds the files of closed days, those before a date, into files of about ``file_bytes``.

    Days that have no more than ``few`` files beyond what their size asks for stay as they are. All
    days are read and written by one job; returns the days.
    """
    finish_swaps(spark, path)
    folder = _Folder(spark, path)
    closed = {day: folder.data_files(day) for day in folder.days() if day < f"day={before}"}
    small = {
        day: held for day, held in closed.items() if len(held) > few + -(-sum(held.values()) // file_bytes)
    }
    if small:
        _rewrite(spark, path, small, file_bytes)
    return sorted(small)


def upkept(
    spark: SparkSession, path: str, as_of: dt.datetime, read: Callable[[SparkSession, str], DataFrame]
) -> DataFrame:
    """The log after expiry and folding of all closed days."""
    expire(spark, path, as_of)
    fold_files(spark, path, as_of.date())
    return read(spark, path)
