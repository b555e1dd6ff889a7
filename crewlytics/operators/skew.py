"""Joins that stay balanced when one key holds a large share of the rows.

There are two ways.  Without a table of hot keys (``hot`` is None, the default of all reports)
joins are written so that adaptive execution can split an uneven partition when it has seen
its size: the long table is on a side that may be split, and the other side is dealt anew for
the join (``dealt_anew``).  That needs no look at the table beforehand, whatever its size.

With a table of hot keys (``hot_rows`` given, for sessions without adaptive execution) a hot
key is split into parts.  Every row of the large side goes to one part of its key; the matching
rows of the other side are repeated once per part.  Keys that are not hot have a single part,
so nothing is repeated for them.  ``heavy_keys`` finds the table when the query runs, without a
shuffle of one row per key: a sketch of bounded size names a few candidates, and only these are
counted exactly.

The result is that of the plain join, whichever keys are called hot.  There is one plan for
short and long tables, and nothing is counted while a query is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

HOT_ROWS = 5_000_000
SHARE = 4096  # a hot key also holds more than this fraction of its table
COUNTERS = 4 * SHARE
ROW = "_row"
PART = "_part"
OTHER_PART = "_other_part"


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key, combined inside each task before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def hot_keys(counts: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of parts each is split into.

    There are at most total rows / ``hot_rows`` of them, which bounds the broadcast.
    The counts are exact, so both sides of a join see the same parts even if the list
    is computed again after a lost executor.
    """
    parts = F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("int")
    hot = counts.where(F.col("_rows") > hot_rows)
    return F.broadcast(hot.select(*keys, parts.alias("_parts")))


def heavy_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same for the keys that also hold more than 1 / ``SHARE`` of the rows.

    A count-min sketch of one row: keys are hashed to ``COUNTERS`` counters, which are summed up
    inside each task and then across them, so no more than ``COUNTERS`` rows a task are
    shuffled, whatever the number of keys.  A counter is never below the count of a key in it,
    so the keys above both limits are in one of the at most ``SHARE`` counters that are.  Only
    keys of those are counted exactly; without any the table is not read again.  Sums and
    counts do not depend on the order of rows, so every reading names the same keys.
    """
    keys = df.select(F.col(key).alias("_key")).where("_key IS NOT NULL")
    keys = keys.withColumn("_counter", F.pmod(F.xxhash64("_key"), F.lit(COUNTERS)))
    sketch = keys.groupBy("_counter").agg(F.count(F.lit(1)).alias("_n"))
    full = F.when(F.col("_n") > hot_rows, F.struct(F.col("_counter").alias("_hot_counter"), "_n"))
    merged = sketch.agg(F.sum("_n").alias("_all"), F.collect_list(full).alias("_full"))
    some = merged.select(F.expr(f"_all div {SHARE}").alias("_hot_share"), F.inline("_full"))
    some = some.where("_n > _hot_share").select("_hot_counter", "_hot_share")
    counted = keys.join(F.broadcast(some), F.col("_counter") == F.col("_hot_counter"))
    counts = counted.groupBy("_key", "_hot_share").agg(F.count(F.lit(1)).alias("_rows"))
    found = counts.where(F.col("_rows") > F.greatest("_hot_share", F.lit(hot_rows)))
    return hot_keys(found.select(F.col("_key").alias(key), "_rows"), [key], hot_rows)


def dealt_anew(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """The same rows with the keys computed anew.

    Where ``df`` comes from an aggregate or a join over these keys, Spark would join in the
    same stage and could not split it; for keys of its own it shuffles once more.
    """
    kinds = dict(df.dtypes)
    anew = {k: F.concat(k, F.lit("")) if kinds[k] == "string" else F.col(k).bitwiseOR(0) for k in on}
    return df.withColumns(anew)


def numbered(df: DataFrame) -> DataFrame:
    """Adds a row number to a scanned table.

    Put directly above a scan of files it depends only on the file split and the position
    in it, so a repeated task numbers its rows the same way; tables from elsewhere are
    sorted inside their partitions first (``settled`` in ``sources/workforce.py``).
    """
    return df.withColumn(ROW, F.monotonically_increasing_id())


def _with_parts(df: DataFrame, hot: DataFrame | None, on: Mapping[str, str]) -> DataFrame:
    named = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in on.values()], "_parts")
    match = [F.col(mine) == F.col(f"_hot_{theirs}") for mine, theirs in on.items()]
    joined = df.join(F.broadcast(named), match, "left")
    return joined.drop(*[f"_hot_{k}" for k in on.values()])


def split_rows(df: DataFrame, hot: DataFrame | None, on: Mapping[str, str], into: str = PART) -> DataFrame:
    """Sends each row of a hot key to one of its parts, chosen by the row number.

    A row without a key has no partner; its row number stands in as the part, so that
    such rows spread out as well instead of meeting in the partition of NULL.
    """
    if hot is None:
        return df.withColumn(into, F.lit(0).cast("long"))  # adaptive execution splits
    part = F.pmod(F.col(ROW), F.coalesce(F.col("_parts"), F.lit(1)).cast("long"))
    for name in on:
        part = F.when(F.col(name).isNull(), F.col(ROW)).otherwise(part)
    return _with_parts(df, hot, on).withColumn(into, part).drop("_parts")


def repeat_rows(df: DataFrame, hot: DataFrame | None, on: Mapping[str, str], into: str = PART) -> DataFrame:
    """Repeats each row of a hot key once per part."""
    if hot is None:
        return df.withColumn(into, F.lit(0).cast("long"))
    last = F.coalesce(F.col("_parts"), F.lit(1)).cast("long") - 1
    parts = F.sequence(F.lit(0).cast("long"), last)
    return _with_parts(df, hot, on).withColumn(into, F.explode(parts)).drop("_parts")


def same_part(left: str, right: str) -> list[Column]:
    """The extra join condition between a split and a repeated side."""
    return [F.col(f"{left}.{PART}") == F.col(f"{right}.{PART}")]


def spread_outer(
    one: DataFrame, many: DataFrame, on: Sequence[str], hot: DataFrame | None, kept: str = "true"
) -> DataFrame:
    """Left join of ``one`` with a long table that may hold hot keys; needs it numbered.

    A left join cannot be split on its right side.  Without hot keys it is written as its two
    halves, an inner join and the rows of ``one`` without a partner.  With them each row of
    ``one`` with a hot key is repeated once per part.  A hot key has rows by definition, so where
    such a repetition finds none in its part it is dropped.  ``kept`` filters the long table's
    rows; a row of ``one`` whose partners all fail it is lost, as in the plain left join with
    the filter behind it.
    """
    same = {name: name for name in on}
    if hot is None:
        matched = many.where(kept).join(dealt_anew(one, on), list(on))
        lonely = one.join(many.select(*on).distinct(), list(on), "left_anti")
        lonely = lonely.withColumn(ROW, F.xxhash64(*on))
        return matched.unionByName(lonely, allowMissingColumns=True)
    last = F.coalesce(F.col("_parts"), F.lit(1)).cast("long") - 1
    parts = F.explode(F.sequence(F.lit(0).cast("long"), last))
    left = _with_parts(one, hot, same).withColumn(PART, parts)
    right = split_rows(many, hot, same).withColumn("_kept", F.expr(kept))
    joined = left.join(right, [*on, PART], "left")
    found = F.col(ROW).isNotNull()
    rows = joined.where(F.when(found, F.col("_kept")).otherwise(F.col("_parts").isNull()))
    rows = rows.withColumn(ROW, F.coalesce(ROW, F.xxhash64(*on)))
    return rows.drop(PART, "_parts", "_kept")


def padded(many: DataFrame, keys: DataFrame, on: Sequence[str], present: DataFrame | None = None) -> DataFrame:
    """A numbered long table with one row more for each key of ``keys`` that it has no row of.

    Such a row is NULL but for its key and number.  The inner join of a table with these keys and the
    result is its left join with the long table; it may be split on the long side, and takes the table
    once.  ``present`` is a shorter table with the keys of ``many``.
    """
    present = many if present is None else present
    lonely = keys.select(*on).distinct().join(present.select(*on).distinct(), list(on), "left_anti")
    return many.unionByName(lonely.withColumn(ROW, F.xxhash64(*on)), allowMissingColumns=True)


def spread_join(
    big: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    hot: DataFrame | None,
    how: str = "inner",
) -> DataFrame:
    """Inner or left join of a numbered large table on same-named columns."""
    same = {name: name for name in on}
    left = split_rows(big, hot, same)
    right = repeat_rows(other, hot, same)
    return left.join(right, [*on, PART], how).drop(PART)


def spread_both(
    left: DataFrame, right: DataFrame, on: Sequence[str], hot_left: DataFrame | None, hot_right: DataFrame | None
) -> DataFrame:
    """Inner join of two numbered long tables, either of which may hold hot keys.

    The rows of a key form a grid: each side is dealt to its own parts and repeated for
    those of the other, so a task gets one part of each.  Rows keep the numbers of the left side.
    """
    same = {name: name for name in on}
    one = repeat_rows(split_rows(left, hot_left, same), hot_right, same, OTHER_PART)
    two = repeat_rows(split_rows(right, hot_right, same, OTHER_PART), hot_left, same)
    return one.join(two.drop(ROW), [*on, PART, OTHER_PART]).drop(PART, OTHER_PART)
