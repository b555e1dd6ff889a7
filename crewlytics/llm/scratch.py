"""Tables that operators write between their steps, in the folder the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crewlytics.sources.scratch import shared_folder


def stored(df: DataFrame, purpose: str, *folders: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back.

    The columns ``folders`` become folders, so a filter on them reads no others.
    This cuts the lineage: what follows never repeats the work before it, and a lost
    executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``stored`` has written, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
