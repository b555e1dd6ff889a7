"""Days met with intervals by sorting, without a pair of row and interval per person.

Each function sorts the days and the bounds of one person together and carries a value along.
Its work per person is the number of days plus the number of bounds, where a join on the person
with a test of the bounds behind it would be their product.  Callers give each day of a person
once, so a person's share is bounded by the calendar and not by the rows behind a day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crewlytics.functions.dates import open_ended


def carried(
    days: DataFrame, marks: DataFrame, who: Sequence[str], at: str, since: str, value: str
) -> DataFrame:
    """Adds the ``value`` of the last mark at or before the day ``at`` of the same key.

    A mark whose day ``since`` is NULL holds from the beginning, and a row without a day meets
    only such a mark.  Marks must have a value; rows of an incomplete key match nothing.
    """
    complete = [F.col(c).isNotNull() for c in who]
    known = marks.select(*who, F.col(since).alias("_at"), F.col(value), F.lit(0).alias("_asks"))
    for test in complete:
        known = known.where(test)
    asked = days.withColumns({"_at": F.col(at), "_asks": F.lit(1)})
    both = asked.unionByName(known, allowMissingColumns=True)
    line = Window.partitionBy(*who).orderBy(F.col("_at").asc_nulls_first(), "_asks")
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn(value, F.last(value, ignorenulls=True).over(so_far))
    return met.where("_asks = 1").select(*days.columns, value)


def interval_totals(
    days: DataFrame,
    intervals: DataFrame,
    who: Sequence[str],
    at: str,
    weight: str,
    bounds: tuple[str, str],
    by: Sequence[str],
    label: str,
) -> DataFrame:
    """Total ``weight`` of the days inside the intervals, per ``by`` (columns of the key) and label.

    A day counts for every interval that holds it, bounds included and a missing end open; a
    day that lies in none counts once for the label NULL.  What an interval holds is the running
    total at its end less the one before its start, so nothing is paired.  Weights are positive.
    """
    first, last = bounds
    spans = intervals.where(F.col(first) <= open_ended(F.col(last)))
    for c in who:
        spans = spans.where(F.col(c).isNotNull())
    stays = spans.groupBy(*who, F.col(first).alias("_from"), open_ended(F.col(last)).alias("_to"), label)
    ends = F.array(
        F.struct(F.col("_from").alias("_at"), F.lit(0).alias("_turn"), F.col("_same").alias("_opened")),
        F.struct(F.col("_to").alias("_at"), F.lit(2).alias("_turn"), (-F.col("_same")).alias("_opened")),
    )
    turns = stays.agg(F.count(F.lit(1)).alias("_same")).select(*who, label, F.inline(ends))
    asked = days.select(
        *who, F.col(at).alias("_at"), F.lit(1).alias("_turn"), F.col(weight).alias("_weight")
    )
    both = turns.unionByName(asked, allowMissingColumns=True)
    line = Window.partitionBy(*who).orderBy(F.col("_at").asc_nulls_first(), "_turn")
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumns(
        {
            "_total": F.coalesce(F.sum("_weight").over(so_far), F.lit(0)),
            "_open": F.coalesce(F.sum("_opened").over(so_far), F.lit(0)),
        }
    )
    share = F.when(F.col("_turn") != 1, -F.col("_opened") * F.col("_total")).when(
        F.col("_open") == 0, F.col("_weight")
    )
    totals = swept.groupBy(*by, label).agg(F.sum(share).alias(weight))
    return totals.where(F.col(weight) > 0)


def tree_nodes(start: str, stop: str) -> Column:
    """The few nodes of a binary tree that together cover the places ``start`` to ``stop`` - 1.

    Node ``n`` of level ``k`` covers the places from ``n * 2^k`` on, ``2^k`` of them; at most two
    nodes of a level are needed.
    """
    low, high = f"(shiftright({start} - 1, k) + 1)", f"shiftright({stop}, k)"
    return F.expr(
        f"""filter(flatten(transform(sequence(0, cast(floor(log2({stop})) as int)), k -> array(
            if({low} < {high} and {low} % 2 = 1, struct(k as level, {low} as node), null),
            if({low} < {high} and {high} % 2 = 1, struct(k as level, {high} - 1 as node), null)
        ))), pair -> pair is not null)"""
    )


def tree_path(place: str, places: str) -> Column:
    """The nodes above one place, up to the level that spans all ``places``."""
    return F.expr(
        f"""transform(sequence(0, cast(floor(log2({places})) as int)),
          k -> struct(k as level, shiftright({place}, k) as node))"""
    )
