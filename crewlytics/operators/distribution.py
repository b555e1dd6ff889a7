"""Grouped counts and sums with labels for missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from crewlytics.functions.text import labelled
from crewlytics.operators.ordering import ranked


@dataclass(frozen=True)
class Dim:
    """One grouping column.

    ``key_label`` replaces NULL before grouping: NULL and a value that equals the label
    become one group.  ``shown_label`` replaces NULL in the finished rows: they stay two
    groups that look alike.
    """

    name: str
    source: str | Column | None = None
    key_label: str | None = None
    shown_label: str | None = None

    def key(self) -> Column:
        source = self.name if self.source is None else self.source
        value = F.col(source) if isinstance(source, str) else source
        return (labelled(value, self.key_label) if self.key_label else value).alias(self.name)

    def shown(self) -> Column:
        value = F.col(self.name)
        return labelled(value, self.shown_label).alias(self.name) if self.shown_label else value


# The usual measures: employees with an id, and the sum of the active flag.
PEOPLE = {"count": "count(emp_id)"}
HEADS = {"value": "sum(is_active)"}


def distribution(
    df: DataFrame,
    dims: Sequence[Dim],
    measures: Mapping[str, str | Column],
    order: Sequence[str],
    limit: int | None = None,
    having: Column | None = None,
) -> DataFrame:
    """Group, measure, sort on the grouped (unlabelled) values, limit, then label.

    Each task aggregates its own rows first, so the shuffle carries one row per group
    and task however unevenly the groups are filled.
    """
    columns = [
        (F.expr(measure) if isinstance(measure, str) else measure).alias(name)
        for name, measure in measures.items()
    ]
    grouped = df.groupBy(*[dim.key() for dim in dims]).agg(*columns)
    if having is not None:
        grouped = grouped.where(having)
    sorted_rows = ranked(grouped, order, limit) if order else grouped
    return sorted_rows.select(*[dim.shown() for dim in dims], *measures)


def distributions(
    df: DataFrame, dims: Mapping[str, Dim], measures: Mapping[str, str | Column]
) -> DataFrame:
    """Several distributions over one column each from a single pass over the rows.

    One row per named distribution and ``category``, which is text.  A grouping set stands for
    each, and the set a row belongs to tells a missing value from a column not grouped by.
    """
    keys = {name: f"_key{i}" for i, name in enumerate(dims)}
    keyed = df.withColumns({keys[name]: dim.key() for name, dim in dims.items()})
    columns = [
        (F.expr(measure) if isinstance(measure, str) else measure).alias(name)
        for name, measure in measures.items()
    ]
    sets = [[F.col(key)] for key in keys.values()]
    asked = [F.grouping(key).alias(f"_not{key}") for key in keys.values()]
    grouped = keyed.groupingSets(sets, *keys.values()).agg(*asked, *columns)

    def of_its_set(values: Mapping[str, Column]) -> Column:
        return F.coalesce(*[F.when(F.col(f"_not{keys[n]}") == 0, v) for n, v in values.items()])

    shown = {
        name: labelled(F.col(keys[name]), dim.shown_label) if dim.shown_label else F.col(keys[name])
        for name, dim in dims.items()
    }
    return grouped.select(
        of_its_set({name: F.lit(name) for name in dims}).alias("distribution"),
        of_its_set({name: value.cast("string") for name, value in shown.items()}).alias("category"),
        *measures,
    )
