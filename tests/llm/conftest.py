from __future__ import annotations

import os

import pyarrow.parquet as pq
import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ODD_DOCS = [
    (1, None, "x", "keep"),
    (2, "", None, "keep"),
    (3, " \n\t ", "x", "keep"),
    (None, "a row without an id but with words " * 4, "x", None),
    (None, "a row without an id but with words " * 4, "x", None),
    (4, "one two three", "x", "keep"),
    (5, "long " + "word%d " * 30000 % tuple(range(30000)), "x", "keep"),
    (6, "déjà vu\u00a0naïve ÀÉ z" * 9, "x", "keep"),
    (7, " ".join(f"w{i}" for i in range(60)), "x", "keep"),
    (8, " ".join(f"w{i}" for i in range(60)), "x", "keep"),
    (8, " ".join(f"w{i}" for i in range(60)), "x", "keep"),
    (9, "<|endoftext|> plain\x1ctext", "x", "keep"),
]
SCHEMA = "doc_id long, text string, component string, rank string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""
    return spark.createDataFrame(ODD_DOCS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    """The rows of a test table as dicts."""
    return lambda name: pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


@pytest.fixture(scope="session")
def run(spark):
    """The rows of a registered query over the test tables."""
    from crewlytics.llm.queries import queries

    return lambda name: [r.asDict() for r in queries()[name](spark, DATA).collect()]
