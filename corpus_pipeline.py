"""Documents to training sequences: five stages, each over all that the one before it kept.

Every stage but the last returns the columns of ``documents``; ``run`` writes its result below
``spark.checkpoint.dir`` and the next one reads it from there. No other engine's SQL can say what
fitted trees and a tokenizer do, so there is no ORACLE_SQL; the tests hold each stage against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewlytics.llm import decontamination, pattern_packing, quality_trees, simhash_gray, substring_rlz
from crewlytics.llm.queries import table, tokenizer_path
from crewlytics.llm.scratch import stored

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees fitted to the labels."""
    return quality_trees.keep_good(docs, quality_trees.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: four-word shingles, four bits."""
    return simhash_gray.keep_one(docs, simhash_gray.simhash_groups(docs, 4, 4))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that smaller ones have; one that loses all its words stays, empty."""
    cut = substring_rlz.remove_repeats(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return decontamination.drop_contaminated(docs, found)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return pattern_packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), 2048, 0)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontaminated", decontaminated),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
