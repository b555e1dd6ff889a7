"""Joins with a meaning: look-ups, existence, anti joins, interval and as-of matches."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crewlytics.functions import fixed_values as fv
from crewlytics.functions.dates import open_ended, running_at
from crewlytics.operators.bloom import key_filter, may_match, ruled_out
from crewlytics.operators.ordering import first_by
from crewlytics.operators.sweep import carried, tree_nodes, tree_path


def lookup(
    df: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    value: str,
    default: str | None = None,
    name: str | None = None,
) -> DataFrame:
    """Adds a value found in a dimension, with a default where nothing is found.

    The dimension is broadcast by Spark while it is under the broadcast threshold and
    shuffled on the key otherwise.
    """
    name = name or value
    found = dim.select(*on, F.col(value).alias(name))
    out = df.join(found, list(on), "left")
    return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))


def without_match(
    df: DataFrame, other: DataFrame, on: Mapping[str, str], bloom_words: int | None = None
) -> DataFrame:
    """Rows of ``df`` that have no partner; ``on`` maps its columns to the other side's.

    The other side is reduced to its distinct keys first, inside each task and then
    across them, so repeated keys cost nothing in the join.

    With ``bloom_words`` a Bloom filter of that many 64-bit words is made of the other side's keys.
    Rows of ``df`` that it rules out are returned without a shuffle; only the rest goes through the
    exact join. Both sides are read twice then, so it pays where ``df`` is wide or long, too
    large to broadcast against, and mostly without partners. The keys must be of the same types.
    """
    keys = other.select(*[F.col(theirs).alias(f"_k{i}") for i, theirs in enumerate(on.values())])
    match = [F.col(mine) == F.col(f"_k{i}") for i, mine in enumerate(on)]
    if bloom_words is None:
        return df.join(keys.distinct(), match, "left_anti")
    kinds = dict(df.dtypes)
    if [kinds[mine] for mine in on] != [kind for _, kind in keys.dtypes]:
        raise ValueError(f"a Bloom filter needs keys of the same types: {dict(on)}")
    found = key_filter(keys, keys.columns, bloom_words)
    unsure = may_match(df, found, list(on), bloom_words)
    sure = ruled_out(df, found, list(on), bloom_words)
    return sure.union(unsure.join(keys.distinct(), match, "left_anti"))


def exists_flag(df: DataFrame, other: DataFrame, on: Mapping[str, str], name: str) -> DataFrame:
    """Adds a boolean column: does the row have any partner?"""
    keys = other.select(*[F.col(theirs).alias(f"_k{i}") for i, theirs in enumerate(on.values())])
    match = [F.col(mine) == F.col(f"_k{i}") for i, mine in enumerate(on)]
    flagged = df.join(keys.distinct(), match, "left").withColumn(name, F.col("_k0").isNotNull())
    return flagged.drop(*[f"_k{i}" for i in range(len(on))])


def running_spells(spells: DataFrame, as_of: dt.date) -> DataFrame:
    """Work spells that are running at a date."""
    return spells.where(running_at(F.col("start_date"), F.col("end_date"), as_of))


def spell_join(df: DataFrame, spells: DataFrame, at: str) -> DataFrame:
    """Adds the site of every work spell of the employee that contains a day.

    Needs ``emp_no`` and ``company_id``; a row without a spell is kept once, a row with
    overlapping spells is repeated.
    """
    side = spells.select(
        F.col("emp_no").alias("_emp"),
        F.col("company_id").alias("_company"),
        F.col("start_date").alias("_from"),
        open_ended(F.col("end_date")).alias("_to"),
        "site_code",
    )
    match = [
        F.col("emp_no") == F.col("_emp"),
        F.col("company_id") == F.col("_company"),
        F.col(at).between(F.col("_from"), F.col("_to")),
    ]
    return df.join(side, match, "left").drop("_emp", "_company", "_from", "_to")


def _preference() -> list[Column]:
    """Primary assignments first, then the latest end; the rest only breaks ties."""
    return [
        F.when(F.col("is_primary") == 1, 1).otherwise(2),
        F.col("valid_to").desc_nulls_first(),
        F.col("valid_from").asc_nulls_last(),
        F.col("pos_code").asc_nulls_last(),
        F.col("org_code").asc_nulls_last(),
    ]


def _preference_rank() -> Column:
    """The same preference as one comparable value, smallest first."""
    return F.struct(
        F.when(F.col("is_primary") == 1, 1).otherwise(2),
        F.col("valid_to").isNotNull(),
        -F.unix_date("valid_to"),
        F.col("valid_from").isNull(),
        F.col("valid_from"),
        F.col("pos_code").isNull(),
        F.col("pos_code"),
        F.col("org_code").isNull(),
        F.col("org_code"),
    )


def assignment_timeline(assignments: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """Which assignment counts for an employee on which days.

    For a day the choice is: an assignment valid on that day outside the excluded unit;
    without one, any assignment.  Within the choice the preference above decides.
    Between two days on which some validity starts or stops the answer cannot change, so
    it is worked out once per stretch of days (``from_day`` inclusive, ``until_day``
    exclusive, NULL meaning without bound) instead of once per training participation.
    An employee has at most one stretch per calendar day and company, which also bounds
    the sets of days gathered here; of assignments with equal bounds only the preferred
    one is looked at.

    ``running`` may add employees known from elsewhere; they are marked ``is_active``.
    """
    who = ["emp_no", "company_id"]
    counted = (F.col("org_code") != fv.EXCLUDED_ORG) & (F.col("valid_from") <= F.col("valid_to"))
    rows = assignments.withColumn("assigned", F.lit(True)).withColumn("is_active", F.lit(False))
    if running is not None:
        known = running.select(*who, F.lit(False).alias("assigned"), F.lit(True).alias("is_active"))
        rows = rows.unionByName(known, allowMissingColumns=True)
    days = F.array_union(
        F.collect_set(F.when(counted, F.col("valid_from"))),
        F.collect_set(F.when(counted, F.date_add("valid_to", 1))),
    )
    codes = F.struct("org_code", "pos_code")
    employees = rows.groupBy(*who).agg(
        F.max("assigned").alias("assigned"),
        F.max("is_active").alias("is_active"),
        F.min_by(codes, F.when(F.col("assigned"), _preference_rank())).alias("_any"),
        F.array_sort(days).alias("_days"),
    )
    open_day = F.array(F.lit(None).cast("date"))
    bounds = F.arrays_zip(
        F.concat(open_day, F.col("_days")).alias("from_day"),
        F.concat(F.col("_days"), open_day).alias("until_day"),
    )
    known = [*who, "assigned", "is_active", "_any"]
    stretches = employees.select(
        *known, (F.size("_days") + 1).alias("_places"), F.posexplode(bounds).alias("_place", "_bounds")
    ).select(*known, "_places", "_place", "_bounds.*")

    spans = [*who, "valid_from", "valid_to"]
    candidates = first_by(assignments.where(counted), spans, _preference())
    best = _best_by_node(candidates, who)
    paths = stretches.withColumn("_node", F.explode(tree_path("_place", "_places")))
    stretch = [*known, "from_day", "until_day"]
    chosen = (
        paths.select(*stretch, "_node.*")
        .join(best, [*who, "level", "node"], "left")
        .groupBy(*stretch)
        .agg(F.min("_best").alias("_best"))
    )
    return chosen.select(
        *who,
        "from_day",
        "until_day",
        "assigned",
        "is_active",
        *[
            F.when(F.col("_best").isNotNull(), F.col(f"_best.codes.{c}"))
            .otherwise(F.col(f"_any.{c}"))
            .alias(c)
            for c in ("org_code", "pos_code")
        ],
    )


def _best_by_node(candidates: DataFrame, who: Sequence[str]) -> DataFrame:
    """The preferred candidate for each node of a tree over an employee's stretches.

    A candidate is noted at the few nodes that cover its stretches, and a stretch looks at the nodes
    above it: for n candidates n log n rows, where testing each against each stretch makes n * n.
    """
    bound = F.array(
        F.struct(F.col("valid_from").alias("_at"), F.lit(True).alias("_opens")),
        F.struct(F.date_add("valid_to", 1).alias("_at"), F.lit(False).alias("_opens")),
    )
    choice = F.struct(
        _preference_rank().alias("rank"), F.struct("org_code", "pos_code").alias("codes")
    )
    span = [*who, "valid_from", "valid_to"]
    ends = candidates.select(*span, choice.alias("_best"), F.inline(bound))
    # The place of a day among an employee's bounds is that of the stretch it begins.
    place = F.dense_rank().over(Window.partitionBy(*who).orderBy("_at"))
    placed = ends.withColumn("_place", place).groupBy(*span).agg(
        F.max(F.when(F.col("_opens"), F.col("_place"))).alias("_start"),
        F.max(F.when(~F.col("_opens"), F.col("_place"))).alias("_stop"),
        F.min("_best").alias("_best"),
    )
    nodes = placed.select(*who, "_best", F.inline(tree_nodes("_start", "_stop")))
    return nodes.groupBy(*who, "level", "node").agg(F.min("_best").alias("_best"))


def in_stretch(day: Column, from_day: Column, until_day: Column) -> Column:
    """True for the one stretch that holds a day; a missing day belongs to the first."""
    return F.when(day.isNull(), from_day.isNull()).otherwise(
        (from_day.isNull() | (day >= from_day)) & (until_day.isNull() | (day < until_day))
    )


def assignments_on(days: DataFrame, assignments: DataFrame, at: str) -> DataFrame:
    """Adds unit and position codes of the assignment on a day, each day of an employee given once.

    Needs ``emp_no`` and ``company_id``; rows without any assignment keep NULL codes.
    """
    codes = F.struct("org_code", "pos_code", "assigned").alias("_codes")
    marks = assignment_timeline(assignments).select("emp_no", "company_id", "from_day", codes)
    found = carried(days, marks, ["emp_no", "company_id"], at, "from_day", "_codes")
    return found.select(
        *days.columns,
        "_codes.org_code",
        "_codes.pos_code",
        F.coalesce("_codes.assigned", F.lit(False)).alias("assigned"),
    )


def assignment_match(df: DataFrame, assignments: DataFrame, at: str) -> DataFrame:
    """Adds the unit and position codes of the employee's assignment on a day.

    Needs ``emp_no`` and ``company_id``; rows without any assignment keep NULL codes.  The choice
    is made once per employee and day, and rows of one day then share it.
    """
    who = ["emp_no", "company_id"]
    days = df.select(*who, F.col(at).alias("_day")).distinct()
    side = assignments_on(days, assignments, "_day").alias("a")
    match = [F.col(f"d.{c}") == F.col(f"a.{c}") for c in who]
    match.append(F.col(f"d.{at}").eqNullSafe(F.col("a._day")))
    return df.alias("d").join(side, match, "left").select(
        "d.*", "a.org_code", "a.pos_code", F.coalesce("a.assigned", F.lit(False)).alias("assigned")
    )
