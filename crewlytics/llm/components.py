"""Connected components of a link table, by alternating stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlytics.llm.scratch import discard, stored
from crewlytics.operators.skew import dealt_anew


def _mark(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node, root))").alias("x")
    ).first()
    return row["n"], row["x"]


def _stars(now: DataFrame) -> DataFrame:
    """The links after a round."""
    both = now.union(now.select("root", "node")).toDF("hub", "end")
    least = both.groupBy("hub").agg(F.min("end").alias("low"))
    least = least.select("hub", F.least("hub", "low").alias("low"))
    large = both.join(dealt_anew(least, ["hub"]), "hub").where("end > hub")
    large = large.select(F.col("end").alias("node"), F.col("low").alias("root")).distinct()
    lowest = large.groupBy("node").agg(F.min("root").alias("low"))
    small = large.join(lowest, "node")
    small = small.where("root <> low").select("root", "low").union(lowest.select("node", "low"))
    return small.toDF("node", "root").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); the root is the smallest node reached.

    Each round hangs all larger neighbours of a node on its smallest neighbour, then all
    neighbours of a node that are smaller on the smallest of them. The smallest neighbour is a
    partial aggregate, so a node with very many links sends one row per task. In the inner join
    that follows, its rows are shuffled anew: adaptive execution splits the links of such a node
    only where the other side comes straight from a shuffle. The second join, on the node that
    hangs on several, goes without that further shuffle. Rounds grow with the logarithm
    of the longest path. Links with a null end and links of a node to itself are no links; an
    empty table gives an empty one. Raises RuntimeError when ``max_rounds`` is not enough.
    """
    ends = links.where("a is not null and b is not null and a <> b")
    now = stored(
        ends.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(),
        "links",
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            return now
        after = stored(_stars(now), "links")
        again = _mark(after)
        discard(now)
        now, done = after, again == mark
        mark = again
        if done:
            return now
    raise RuntimeError(f"no end after {max_rounds} rounds")
