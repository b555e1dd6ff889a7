"""Numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from crewlytics.functions import fixed_values as fv


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(numerator: Column, denominator: Column, scale: int = 1) -> Column:
    return F.round(ratio(numerator, denominator) * 100, scale)


def mean_or_zero(value: Column) -> Column:
    """Average of a decimal column, 0 where there is nothing to average.

    The decimal average is exact, so it does not depend on the order in which
    partial results arrive.
    """
    return F.coalesce(F.avg(value), F.lit(0)).cast("double")


def age_band(stored: Column, age: Column) -> Column:
    """The stored band, else one computed from the age, else the unknown label."""
    computed = F.when(age <= fv.COMPUTED_BANDS[0][0], fv.COMPUTED_BANDS[0][1])
    for upper, name in fv.COMPUTED_BANDS[1:]:
        computed = computed.when(age <= upper, name)
    computed = computed.when(age.isNotNull(), fv.COMPUTED_BAND_ABOVE).otherwise(fv.UNKNOWN)
    return F.coalesce(stored, computed)


def training_hours(duration: Column, unit: Column) -> Column:
    """Length of an event in hours, as a decimal; NULL for a unit that has no hour value."""
    factors = [F.lit(x) for pair in fv.HOURS_PER_UNIT.items() for x in pair]
    return duration * F.try_element_at(F.create_map(*factors), unit)


def row_uniform(key: Column, seed: int, part: int) -> Column:
    """A uniform number in [0, 1) that belongs to a row.

    It is a function of the row key and the seed, so a recomputed task, another
    partitioning or another cluster size gives the same row the same number.
    ``part`` (0, 1, 2) selects independent numbers for one row.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    digits = F.substring(digest, 1 + part * 10, 10)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**10))


def random_between(key: Column, seed: int, part: int, low: float, high: float, scale: int) -> Column:
    return F.round(row_uniform(key, seed, part) * (high - low) + low, scale)
