"""Sums per period kept beside a table in period folders, made anew only for folders that changed.

Each period's folder of sums holds its rows and, with them, a stamp of the table's folder as it was
before it was read: names, sizes and times of its files. ``renew`` compares stamps, reads the
folders that differ, and overwrites just these periods; sums of folders that are gone go too. Files
that arrive while it runs leave an old stamp behind, so the next run takes them up. A crash leaves
each period with old sums or none, which the next run makes good. One job renews at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from crewlytics.sources.folders import Folder

STAMP, FOUND = "_stamp", "_found"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _value(folder: str) -> str | None:
    value = folder.partition("=")[2]
    return None if value == NO_VALUE else unquote(value)


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema.add(STAMP, "string").add(FOUND, "boolean")).parquet(path)


def renew(
    spark: SparkSession,
    table: str,
    schema: StructType,
    period: str,
    summed: Callable[[DataFrame], DataFrame],
    path: str,
) -> list[str]:
    """Brings the sums in ``path`` up to date with a Parquet table; returns the folders that were read.

    ``schema`` is the table's, ``period`` its partition column, a text. ``summed`` gives one or
    more rows a period with the period among the columns; a period whose rows it leaves out
    keeps its stamp alone. Only folder names and stamps, one of each a period, pass the driver.
    """
    source, kept = Folder(spark, table), Folder(spark, path)
    stamps = {name: source.stamp(name) for name in source.entries() if name.startswith(f"{period}=")}
    stamps = {name: stamp for name, stamp in stamps.items() if stamp}
    known: dict[str | None, str] = {}
    held = [name for name in kept.entries() if name.startswith(f"{period}=")]
    if held:
        stored = StructType([f for f in schema if f.name == period])
        known = {r[0]: r[1] for r in _stored(spark, path, stored).select(period, STAMP).distinct().collect()}
    for name in held:
        if name not in stamps:
            kept.delete(name)
    changed = sorted(name for name, stamp in stamps.items() if known.get(_value(name)) != stamp)
    if changed:
        root = table.rstrip("/")
        reader = spark.read.schema(schema).option("basePath", root)
        sums = summed(reader.parquet(*[f"{root}/{name}" for name in changed])).withColumn(FOUND, F.lit(True))
        listed = F.array(*[_row(_value(name), stamps[name]) for name in changed])
        periods = spark.range(1).select(F.inline(listed))
        same = sums[period].eqNullSafe(periods["_period"])
        rows = periods.join(sums, same, "left").drop(sums[period]).withColumnRenamed("_period", period)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(period).parquet(path)
    return changed


def _row(value: str | None, stamp: str) -> Column:
    return F.struct(F.lit(value).cast("string").alias("_period"), F.lit(stamp).alias(STAMP))


def read_sums(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The kept sums; ``schema`` is that of the rows ``summed`` gave."""
    if not Folder(spark, path).entries():
        return spark.createDataFrame([], schema)
    return _stored(spark, path, StructType(list(schema))).where(FOUND).select(*schema.names)
