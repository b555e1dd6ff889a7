"""One object that hands out the workforce tables, wherever they live."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from crewlytics.sources.derived import DERIVATIONS
from crewlytics.sources.schemas import VIEW_SCHEMAS, blank_to_null, checked, view_schema

# Options that keep blanks and fractions of a second in text files.
TEXT_OPTIONS = {
    "csv": {
        "header": True,
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    },
    "json": {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
}

# Views written with a partition column, so that a period or a day reads only its folders.
PARTITION_COLUMNS = {"personnel_month": "year_month", "interactions": "day"}

# The long tables whose hot keys are dealt to parts by row number.
NUMBERED = ["training_participant", "training_event_course"]


def settled(df: DataFrame, name: str) -> DataFrame:
    """A table that is numbered, its rows in a fixed order inside each partition.

    A database or a view that shuffles may give a repeated task its rows in another order;
    sorted by all columns they get the same numbers again.  Files need no such sort.
    """
    return df.sortWithinPartitions(*df.columns) if name in NUMBERED else df


class Workforce:
    """Tables by attribute: ``w.personnel``, ``w.training_event``, …

    Frames are lazy and built on first use; nothing is read until a report runs.
    """

    def __init__(
        self,
        spark: SparkSession,
        load: Callable[[str], DataFrame],
    ):
        self.spark = spark
        self._load = load
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEW_SCHEMAS:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._load(name)
        return self._frames[name]

    def narrowed(self, ids: DataFrame, key: str, names: Iterable[str]) -> Workforce:
        """The same tables, some of them reduced to the rows with a listed key, NULL included."""
        wanted = ids.select(F.col(key).alias("_wanted"))

        def load(name: str) -> DataFrame:
            table = getattr(self, name)
            same = F.col(key).eqNullSafe(F.col("_wanted"))
            return table.join(wanted, same, "left_semi") if name in names else table

        return Workforce(self.spark, load)

    @classmethod
    def derived(cls, spark: SparkSession, directory: str) -> Workforce:
        """Views computed from the star-schema parquet tables in ``directory``."""
        return cls(spark, lambda name: DERIVATIONS[name](spark, directory))

    @classmethod
    def stored(cls, spark: SparkSession, root: str, fmt: str = "parquet") -> Workforce:
        """Views written by :func:`write_views`, one folder per view.

        Columns are read as they are, so every filter of a report reaches the files.
        """

        def load(name: str) -> DataFrame:
            schema = view_schema(name)
            if name in PARTITION_COLUMNS and PARTITION_COLUMNS[name] not in schema.names:
                schema = schema.add(PARTITION_COLUMNS[name], "date")
            reader = spark.read.schema(schema).options(**TEXT_OPTIONS.get(fmt, {}))
            return checked(reader.format(fmt).load(f"{root}/{name}"), name)

        return cls(spark, load)

    @classmethod
    def catalog(cls, spark: SparkSession, database: str, raw: bool = False) -> Workforce:
        """Views kept as tables of a catalog database.

        ``raw`` tables may hold empty text for missing values; it is read as NULL.  That
        hides text columns from file filters, so it is better done once on writing.
        """

        def load(name: str) -> DataFrame:
            table = spark.table(f"{database}.{name}")
            return settled(checked(blank_to_null(table) if raw else table, name), name)

        return cls(spark, load)

    @classmethod
    def jdbc(
        cls,
        spark: SparkSession,
        url: str,
        tables: dict[str, str],
        splits: dict[str, tuple[str, int, int, int]] | None = None,
        properties: dict[str, str] | None = None,
        raw: bool = False,
    ) -> Workforce:
        """Views read from a database.

        ``tables`` maps a view to its table or subquery; ``splits`` gives a view's
        (column, lower, upper, partitions) so that the read itself is spread out.
        ``raw`` is that of :meth:`catalog`.
        """

        def load(name: str) -> DataFrame:
            options = jdbc_options(url, tables[name], (splits or {}).get(name), properties)
            loaded = spark.read.format("jdbc").options(**options).load()
            named = loaded.select(*[F.col(c).alias(c.lower()) for c in loaded.columns])
            types = view_schema(name)
            typed = named.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in types])
            return settled(checked(blank_to_null(typed) if raw else typed, name), name)

        return cls(spark, load)


def jdbc_options(
    url: str,
    table: str,
    split: tuple[str, int, int, int] | None,
    properties: dict[str, str] | None,
) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "fetchsize": "10000", **(properties or {})}
    if split is not None:
        column, lower, upper, partitions = split
        options |= {
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def write_views(
    workforce: Workforce,
    root: str,
    names: Iterable[str] = tuple(VIEW_SCHEMAS),
    fmt: str = "parquet",
) -> None:
    """Materialise views, one folder each, for :meth:`Workforce.stored`.

    Empty text becomes NULL here, once.
    The rebalance hint evens out the written files: small partitions are merged and a
    month or day that holds much of the data is split over many writers.
    """
    for name in names:
        df = blank_to_null(getattr(workforce, name))
        column = PARTITION_COLUMNS.get(name)
        if column == "day":
            df = df.withColumn("day", F.to_date("ts"))
        df = df.hint("rebalance", column) if column else df.hint("rebalance")
        writer = df.write.mode("overwrite").format(fmt).options(**TEXT_OPTIONS.get(fmt, {}))
        if column:
            writer = writer.partitionBy(column)
        writer.save(f"{root}/{name}")


def register_views(workforce: Workforce, names: Iterable[str] = tuple(VIEW_SCHEMAS)) -> None:
    """Make the views available to ``spark.sql`` under their own names."""
    for name in names:
        getattr(workforce, name).createOrReplaceTempView(name)


def named_tables(spark: SparkSession, query: str) -> list[str]:
    """Unqualified table names in a query, lower case, as Spark's parser reads it.

    Taken from the parsed plan that EXPLAIN gives, whether or not the tables exist; words in
    texts, comments, aliases and column names are no tables. A name that a WITH clause defines is
    among them, as the clause itself may read a table of that name. Nothing is run.
    """
    plan = spark.sql(f"EXPLAIN EXTENDED {query}").first()[0]
    parsed = plan.partition("== Parsed Logical Plan ==")[2].partition("== Analyzed Logical Plan ==")[0]
    return sorted({name.lower() for name in re.findall(r"(?m)^[\s:+-]*'UnresolvedRelation \[(\w+)\]", parsed)})


@contextmanager
def views_for(workforce: Workforce, names: Iterable[str]) -> Iterator[None]:
    """The views under their own names for a while; views of the session's user come back after."""
    spark = workforce.spark
    before: dict[str, DataFrame] = {}
    for name in names:
        if any(t.isTemporary and t.name.lower() == name for t in spark.catalog.listTables(pattern=name)):
            before[name] = spark.table(name)
    try:
        register_views(workforce, names)
        yield
    finally:
        for name in names:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def run_select(workforce: Workforce, text: str) -> DataFrame:
    """An ad-hoc SELECT over the views it names.

    Only the views that the parsed text reads are registered, and dropped again once Spark has
    resolved them; the frame needs them no more. Only a query is accepted: the text goes into a
    derived table, where a statement that writes or defines something is a syntax error.
    """
    query = f"SELECT * FROM (\n{text.strip().rstrip(';')}\n)"
    named = set(named_tables(workforce.spark, query))
    with views_for(workforce, [name for name in VIEW_SCHEMAS if name in named]):
        return workforce.spark.sql(query)
