"""Sorting, limits and best-of-group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def sort_key(name: str, collation: str | None = None) -> Column:
    """``'x'`` ascending with NULL last, ``'-x'`` descending with NULL first."""
    column = F.col(name.lstrip("-"))
    value = F.collate(column, collation) if collation else column
    return value.desc_nulls_first() if name.startswith("-") else value.asc_nulls_last()


def ranked(
    df: DataFrame,
    order: Sequence[str],
    limit: int | None = None,
    ties: Sequence[str] | None = None,
    collation: str | None = None,
) -> DataFrame:
    """Sort, and keep the first ``limit`` rows if one is given.

    Columns not named in ``order`` break ties, so a limit always keeps the same rows.
    With a limit Spark plans one pass that keeps the best rows per task.  Text sorts by
    code point unless a collation such as ``'tr'`` is given.
    """
    named = {name.lstrip("-") for name in order}
    rest = [name for name in (df.columns if ties is None else ties) if name not in named]
    kinds = dict(df.dtypes) if collation else {}
    keys = [
        sort_key(name, collation if kinds.get(name.lstrip("-")) == "string" else None)
        for name in [*order, *rest]
    ]
    out = df.orderBy(*keys)
    return out if limit is None else out.limit(limit)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given order.

    Testing the row number against 1 lets Spark drop the losers of every group inside
    each task before the shuffle, so a hot key sends one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
