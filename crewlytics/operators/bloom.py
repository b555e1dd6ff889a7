"""A Bloom filter over join keys: rows it rules out have no partner for sure.

The filter is a table of at most ``words`` 64-bit words. A key sets three bits in one of them, so a
probe is one look-up in a broadcast table of a size that the argument bounds, whatever the number of
keys. It is built by an aggregate that is combined inside each task, and bits do not depend on the
order of rows, so a repeated task builds and reads the same filter. With ten bits a key about one
absent key in fifty passes; a filter with far too many keys lets everything pass and changes nothing
but the time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 1 << 18  # two megabytes of bits, enough for about 1.6 million keys


def _complete(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _word(keys: Sequence[str], words: int) -> Column:
    """The word of a key; NULL, which matches nothing, where a part of the key is missing."""
    return F.when(_complete(keys), F.pmod(F.shiftrightunsigned(F.xxhash64(*keys), 18), F.lit(words)))


def _bits(keys: Sequence[str]) -> Column:
    """Three bits of a word, each chosen by six bits of the hash."""
    def bit(at: int) -> Column:
        place = F.shiftrightunsigned(F.xxhash64(*keys), at).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))


def key_filter(df: DataFrame, keys: Sequence[str], words: int = WORDS) -> DataFrame:
    """The filter of the complete keys of a table."""
    hashed = df.where(_complete(keys)).select(_word(keys, words).alias("_word"), _bits(keys).alias("_set"))
    return F.broadcast(hashed.groupBy("_word").agg(F.bit_or("_set").alias("_set")))


def _hit(keys: Sequence[str], words: int) -> Column:
    bits = _bits(keys)
    return (_word(keys, words) == F.col("_word")) & (F.col("_set").bitwiseAND(bits) == bits)


def may_match(df: DataFrame, found: DataFrame, keys: Sequence[str], words: int = WORDS) -> DataFrame:
    """Rows whose key may be in the filtered table: all that are, and a few that are not."""
    return df.join(found, _hit(keys, words), "left_semi")


def ruled_out(df: DataFrame, found: DataFrame, keys: Sequence[str], words: int = WORDS) -> DataFrame:
    """The other rows: no partner for sure, those with an incomplete key included."""
    return df.join(found, _hit(keys, words), "left_anti")
