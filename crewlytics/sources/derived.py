"""The workforce views derived from the star-schema tables.

Small sides (nation, region) are left to Spark's own size check: they are broadcast
only while their files stay under ``spark.sql.autoBroadcastJoinThreshold``.  Joins
between large tables stay plain equi-joins with the large side first, which adaptive
execution can split when one key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crewlytics.sources import view_columns as vc
from crewlytics.sources.base_tables import base_table


def _pick(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def _in_each_region(spark: SparkSession, directory: str, df: DataFrame) -> DataFrame:
    """Every row of ``df`` once per region, as the struct ``r``.

    The keys of the regions, 0 to 4, are fixed by the star schema; the names come by a join.
    """
    region = base_table(spark, directory, "region")
    named = region.select(F.col("r_regionkey").alias("_key"), F.struct(*region.columns).alias("r"))
    keyed = df.withColumn("_key", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return keyed.join(named, "_key").drop("_key")


def _steps(condition=None):
    """One or two copies of a row, numbered ``d.k`` = 0, 1."""
    both = F.array(F.struct(F.lit(0).alias("k")), F.struct(F.lit(1).alias("k")))
    if condition is None:
        return F.explode(both)
    return F.explode(F.when(condition, both).otherwise(F.slice(both, 1, 1)))


def _orders_with_place(spark: SparkSession, directory: str) -> DataFrame:
    orders = base_table(spark, directory, "orders").alias("o")
    customer = base_table(spark, directory, "customer").alias("c")
    nation = base_table(spark, directory, "nation").alias("n")
    region = base_table(spark, directory, "region").alias("r")
    return (
        orders.join(customer, F.col("c.c_custkey") == F.col("o.o_custkey"))
        .join(nation, F.col("n.n_nationkey") == F.col("c.c_nationkey"))
        .join(region, F.col("r.r_regionkey") == F.col("n.n_regionkey"))
    )


def personnel(spark: SparkSession, directory: str) -> DataFrame:
    return _pick(_orders_with_place(spark, directory), vc.PERSONNEL)


def personnel_month(spark: SparkSession, directory: str) -> DataFrame:
    lines = base_table(spark, directory, "lineitem").alias("l")
    staff = personnel(spark, directory).alias("p")
    return _pick(lines.join(staff, F.col("p.emp_id") == F.col("l.l_orderkey")), vc.PERSONNEL_MONTH)


def engagement(spark: SparkSession, directory: str) -> DataFrame:
    return _pick(personnel(spark, directory).alias("p"), vc.ENGAGEMENT)


def training_event(spark: SparkSession, directory: str) -> DataFrame:
    return _pick(_orders_with_place(spark, directory), vc.TRAINING_EVENT)


def training_participant(spark: SparkSession, directory: str) -> DataFrame:
    return _pick(base_table(spark, directory, "lineitem").alias("l"), vc.TRAINING_PARTICIPANT)


def training_participant_qry(spark: SparkSession, directory: str) -> DataFrame:
    return _pick(base_table(spark, directory, "lineitem").alias("l"), vc.TRAINING_PARTICIPANT_QRY)


def training_event_course(spark: SparkSession, directory: str) -> DataFrame:
    orders = base_table(spark, directory, "orders").alias("o")
    linked = orders.select("o.*", _steps(F.col("o_orderkey") % 50 == 0).alias("d")).select(
        F.struct("o_orderkey", "o_custkey").alias("o"), "d"
    )
    return _pick(linked, vc.TRAINING_EVENT_COURSE)


def course(spark: SparkSession, directory: str) -> DataFrame:
    return _pick(base_table(spark, directory, "part").alias("p"), vc.COURSE)


def course_category(spark: SparkSession, directory: str) -> DataFrame:
    kinds = base_table(spark, directory, "part").where("p_type <> 'PROMO'").select("p_type")
    return _pick(kinds.distinct().alias("p"), vc.COURSE_CATEGORY)


def _supplier_per_region(spark: SparkSession, directory: str) -> DataFrame:
    supplier = base_table(spark, directory, "supplier").select(
        F.struct("s_suppkey").alias("s")
    )
    return _in_each_region(spark, directory, supplier).withColumn("d", _steps())


def company_pers_assign(spark: SparkSession, directory: str) -> DataFrame:
    return _pick(_supplier_per_region(spark, directory), vc.COMPANY_PERS_ASSIGN)


def work_spell(spark: SparkSession, directory: str) -> DataFrame:
    spells = _supplier_per_region(spark, directory).where(
        "(s.s_suppkey + r.r_regionkey + d.k) % 4 <> 0"
    )
    return _pick(spells, vc.WORK_SPELL)


def _nation_per_region(spark: SparkSession, directory: str, condition: str) -> DataFrame:
    nation = (
        base_table(spark, directory, "nation")
        .where(condition)
        .select(F.struct("n_nationkey", "n_name").alias("n"))
    )
    return _in_each_region(spark, directory, nation)


def position_dim(spark: SparkSession, directory: str) -> DataFrame:
    return _pick(_nation_per_region(spark, directory, "n_nationkey % 6 <> 5"), vc.POSITION_DIM)


def org_dim(spark: SparkSession, directory: str) -> DataFrame:
    return _pick(_nation_per_region(spark, directory, "n_nationkey < 18"), vc.ORG_DIM)


def staff_group_dim(spark: SparkSession, directory: str) -> DataFrame:
    return _pick(_nation_per_region(spark, directory, "n_nationkey < 4"), vc.STAFF_GROUP_DIM)


def interactions(spark: SparkSession, directory: str) -> DataFrame:
    return log_records(base_table(spark, directory, "events"))


def log_records(events: DataFrame) -> DataFrame:
    """Event rows as interaction records; also works on a stream of events."""
    return _pick(events.alias("e"), vc.INTERACTIONS)


def product(spark: SparkSession, directory: str) -> DataFrame:
    return _pick(base_table(spark, directory, "part").alias("p"), vc.PRODUCT)


def sale(spark: SparkSession, directory: str) -> DataFrame:
    return _pick(base_table(spark, directory, "lineitem").alias("l"), vc.SALE)


DERIVATIONS = {
    fn.__name__: fn
    for fn in (
        personnel,
        personnel_month,
        engagement,
        training_event,
        training_participant,
        training_participant_qry,
        training_event_course,
        course,
        course_category,
        company_pers_assign,
        work_spell,
        position_dim,
        org_dim,
        staff_group_dim,
        interactions,
        product,
        sale,
    )
}
