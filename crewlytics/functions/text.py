"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def labelled(value: Column, label: str) -> Column:
    """The value, or a label where it is missing."""
    return F.coalesce(value, F.lit(label))


def joined(*parts: Column) -> Column:
    """Concatenation in which a missing part counts as empty text."""
    return F.concat_ws("", *[part.cast("string") for part in parts])


def upper_text(value: Column, turkish: bool = False) -> Column:
    """Upper case; on request with the Turkish pair i/İ instead of i/I."""
    return F.upper(F.translate(value, "i", "İ")) if turkish else F.upper(value)


def known(value: Column, placeholder: str, trim: bool = False) -> Column:
    """True where a value is present and is not the placeholder."""
    compared = F.trim(value) if trim else value
    return value.isNotNull() & (compared != placeholder)


def missing(value: Column, placeholder: str) -> Column:
    """True where a value is absent or is exactly the placeholder."""
    return value.isNull() | (value == placeholder)


def contains_ci(value: Column, text: str) -> Column:
    """True where the upper-cased value contains the upper-cased text."""
    return F.contains(F.upper(value), F.upper(F.lit(text)))


def map_code(city: Column, codes: dict[str, str], otherwise: Column) -> Column:
    """The map code of a city, from a small fixed table."""
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), city), otherwise)
