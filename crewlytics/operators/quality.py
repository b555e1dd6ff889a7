"""Key checks over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from crewlytics.operators.bloom import key_filter, may_match


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that are repeated or incomplete, with the number of rows they have."""
    incomplete = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counted.where((F.col("rows") > 1) | incomplete)


def fk_orphans(
    child: DataFrame, parent: DataFrame, on: Mapping[str, str], bloom_words: int | None = None
) -> DataFrame:
    """Child key values without a parent row, with the number of rows that carry them.

    A key with a NULL part refers to nothing and is not an orphan.  Child rows are
    counted per key before the join, so a key that many rows share is joined once.

    With ``bloom_words`` only the parents that a Bloom filter of the child keys lets pass are
    shuffled, which pays where most parents have no child. The keys must be of the same types.
    """
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])
    counted = child.where(complete).groupBy(*on).agg(F.count(F.lit(1)).alias("rows"))
    parents = parent.select(*[F.col(theirs).alias(f"_k{i}") for i, theirs in enumerate(on.values())])
    match = [F.col(mine) == F.col(f"_k{i}") for i, mine in enumerate(on)]
    if bloom_words is not None:
        kinds = dict(child.dtypes)
        if [kinds[mine] for mine in on] != [kind for _, kind in parents.dtypes]:
            raise ValueError(f"a Bloom filter needs keys of the same types: {dict(on)}")
        found = key_filter(child, list(on), bloom_words)
        parents = may_match(parents, found, parents.columns, bloom_words)
    return counted.join(parents, match, "left_anti")
