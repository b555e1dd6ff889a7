"""Session settings that suit wide tables of derived columns."""

from __future__ import annotations

from pyspark.sql import SparkSession

# A generated method above 8,000 bytecodes is never compiled by the JVM, only interpreted.
# Dumps of all snapshot columns reach that; below the limit Spark uses several methods.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
FORCE_SPLIT = "spark.sql.adaptive.forceOptimizeSkewedJoin"
SPARK_DEFAULT = "65535"
JVM_LIMIT = "8000"


def tune(spark: SparkSession) -> SparkSession:
    """Applies the settings a session still has at their defaults.

    Adaptive execution also splits an uneven join where the next one then needs a shuffle.
    """
    if spark.conf.get(FORCE_SPLIT, "false") == "false":
        spark.conf.set(FORCE_SPLIT, "true")
    if spark.conf.get(METHOD_LIMIT, SPARK_DEFAULT) == SPARK_DEFAULT:
        spark.conf.set(METHOD_LIMIT, JVM_LIMIT)
    return spark
