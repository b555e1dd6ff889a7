"""Cleaning and classifying the SQL texts of the interaction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crewlytics.functions import fixed_values as fv

# Fixed patterns of the clean-up; (?iU) ignores case and takes blanks and digits of any script.
OUTER_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LIMIT_CLAUSE = r"(?iU)LIMIT\s+(\d+)"
FETCH_CLAUSE = "FETCH FIRST $1 ROWS ONLY"
TOP_CLAUSE = r"(?iU)SELECT\s+TOP\s+\d+\s+"
FENCES = ["```sql", "```"]


def clean_query(text: Column) -> Column:
    """A SQL text without terminators, quotes, fences, ``LIMIT`` and ``TOP``.

    The order matters: blanks inside a code fence survive because the outer blanks are
    taken off before the fence is.
    """
    text = F.regexp_replace(F.translate(text, ';"', ""), OUTER_BLANKS, "")
    for fence in FENCES:
        text = F.replace(text, F.lit(fence), F.lit(""))
    text = F.regexp_replace(text, LIMIT_CLAUSE, FETCH_CLAUSE)
    has_top = F.contains(F.upper(text), F.lit("TOP "))
    return F.when(has_top, F.regexp_replace(text, TOP_CLAUSE, "SELECT ")).otherwise(text)


def is_write(text: Column) -> Column:
    """True for a statement that changes data or definitions."""
    start = F.upper(F.regexp_replace(text, OUTER_BLANKS, ""))
    return F.coalesce(start.rlike(f"^({'|'.join(fv.WRITE_WORDS)})"), F.lit(False))


def normalise_queries(df: DataFrame, column: str = "generated_sql") -> DataFrame:
    """Adds the cleaned text and whether it is a write statement."""
    cleaned = df.withColumn("clean_sql", clean_query(F.col(column)))
    return cleaned.withColumn("is_write", is_write(F.col("clean_sql")))
