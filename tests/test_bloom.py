"""The Bloom filter before anti joins: no row is lost, and ruled-out rows are not shuffled."""

from __future__ import annotations

import pytest
from frames import rows_of
from pyspark.sql import functions as F

from crewlytics.operators.bloom import WORDS, key_filter, may_match, ruled_out
from crewlytics.operators.matching import without_match
from crewlytics.operators.quality import fk_orphans


def shuffled(df) -> list[int]:
    """Rows written by each shuffle by hash while ``df`` ran."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "Exchange":
            yield node.metrics().apply("shuffleRecordsWritten").value()
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    return sorted(walk(df._jdf.queryExecution().executedPlan()))


@pytest.fixture
def plain_plans(spark):
    """Joins of tables of any size as of large ones, plans as they are first made."""
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("words", [1, 7, WORDS])
def test_results_do_not_depend_on_the_filter(spark, words):
    left = spark.range(3000).select(
        F.when(F.col("id") % 10 != 0, F.col("id") % 700).alias("a"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("x"), F.col("id") % 5)).alias("b"),
        F.col("id").alias("n"),
    )
    right = spark.range(500).select(
        F.when(F.col("id") % 9 != 0, F.col("id") % 90).alias("c"), F.concat(F.lit("x"), F.col("id") % 3).alias("d")
    )
    on = {"a": "c", "b": "d"}
    plain, screened = without_match(left, right, on), without_match(left, right, on, words)
    assert screened.columns == left.columns
    assert rows_of(screened) == rows_of(plain)
    assert rows_of(fk_orphans(left, right, on, words)) == rows_of(fk_orphans(left, right, on))
    found = key_filter(right, ["c", "d"], words)
    parts = may_match(left, found, ["a", "b"], words).union(ruled_out(left, found, ["a", "b"], words))
    assert rows_of(parts) == rows_of(left)


@pytest.mark.parametrize("empty", ["left", "right"])
def test_empty_sides(spark, empty):
    rows = spark.range(20).select(F.col("id").alias("k"))
    left, right = (rows.where("false"), rows) if empty == "left" else (rows, rows.where("false"))
    assert rows_of(without_match(left, right, {"k": "k"}, 16)) == rows_of(left)


def test_ruled_out_rows_are_not_shuffled(spark, plain_plans):
    left = spark.range(100_000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    right = spark.range(99_000, 101_000).select(F.col("id").alias("j"))
    plain = shuffled(without_match(left, right, {"k": "j"}))
    screened = without_match(left, right, {"k": "j"}, WORDS)
    found = shuffled(screened)
    assert plain[-1] == 100_000
    assert found[-1] < 2100 and sum(found) < 10_000
    assert screened.count() == 99_000


def test_parents_without_children_are_not_shuffled(spark, plain_plans):
    child = spark.range(1000).select((F.col("id") % 100 - 1).alias("k"))
    parent = spark.range(50_000).select(F.col("id").alias("j"))
    found = fk_orphans(child, parent, {"k": "j"}, WORDS)
    assert shuffled(found)[-1] <= 1000
    assert [tuple(r) for r in found.collect()] == [(-1, 10)]


def test_few_absent_keys_pass(spark):
    keys = spark.range(100_000).select(F.col("id").alias("k"))
    words = 1 << 14  # ten bits a key
    found = key_filter(keys, ["k"], words)
    absent = spark.range(10**6, 10**6 + 100_000).select(F.col("id").alias("k"))
    assert may_match(keys, found, ["k"], words).count() == 100_000
    assert may_match(absent, found, ["k"], words).count() < 5000


def test_keys_of_other_types_are_refused(spark):
    left, right = spark.range(1).select(F.col("id").cast("int").alias("k")), spark.range(1)
    with pytest.raises(ValueError, match="same types"):
        without_match(left, right, {"k": "id"}, 16)
    with pytest.raises(ValueError, match="same types"):
        fk_orphans(left, right, {"k": "id"}, 16)
