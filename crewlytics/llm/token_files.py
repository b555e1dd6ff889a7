"""Token ids in Parquet list columns, in document order, with selective reads.

One row per document: ``seq`` (place in the corpus: file part and row), the id, ``n_tokens`` and
``tokens``. Whole numbers are dictionary or delta encoded (format v2), row groups and pages have
set sizes, and page indexes let a reader of a few documents fetch only the pages that hold them;
readers of the other columns fetch no tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewlytics.llm.text_arrays import tidy
from crewlytics.llm.tokens import encoder, slices

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PART_BITS = 33  # of ``seq``: Spark's ids hold the row in the lower 33 bits, the part above


def encoded(docs: DataFrame, path: str, spaces: str, end_id: int) -> DataFrame:
    """(id, tokens) of ``docs`` (id, text) in the order given; each ends with ``end_id``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path, spaces)
        for whole in batches:
            for batch in slices(whole, 1):
                ids = tokenizer.encode(batch.column(1))
                bounds = ids.bounds + np.arange(len(ids.bounds))
                flat = np.insert(ids.flat, ids.bounds[1:], np.uint32(end_id))
                tokens = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), tokens.cast(pa.list_(pa.int32()))], ["id", "tokens"]
                )

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, tokens array<int>")


def write_tokens(
    docs: DataFrame, folder: str, path: str, spaces: str, end_id: int, id: str = "doc_id", text: str = "text"
) -> None:
    """Writes the ids of every document to ``folder``, ascending by id.

    A null id comes first; rows with one id are ordered by a hash of their text, so repeated rows
    are all written. Null and empty texts hold the end id alone. Texts are dealt to tasks by id
    ranges, so a task holds a range of the corpus and no more. Other columns are not read.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    order = ["id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    tokens = encoded(rows, path, spaces, end_id)
    tokens = tokens.select(
        F.monotonically_increasing_id().alias("seq"),
        F.col("id").alias(id),
        F.size("tokens").cast("long").alias("n_tokens"),
        "tokens",
    )
    writer = tokens.write.option("compression", "zstd")
    for name, value in {
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": 1000,
    }.items():
        writer = writer.option(name, value)
    writer.parquet(folder)


def read_metadata(spark: SparkSession, folder: str, id: str = "doc_id") -> DataFrame:
    """(seq, id, start, n_tokens) of every document, without reading a token.

    ``start`` counts the ids of all documents before. Sums inside a file come from a window over
    that file's rows, sums of files before from a table of one row per file.
    """
    rows = spark.read.parquet(folder).select("seq", id, "n_tokens")
    rows = rows.withColumn("part", F.shiftright("seq", PART_BITS))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(parts, "part").select(
        "seq", id, (F.col("base") + F.col("inside")).alias("start"), "n_tokens"
    )


def read_tokens(spark: SparkSession, folder: str, ids: list | None = None, id: str = "doc_id") -> DataFrame:
    """The rows of the given ids (all without a list); the filter reaches row groups and pages."""
    rows = spark.read.parquet(folder)
    return rows if ids is None else rows.where(F.col(id).isin(ids))


def checksums(tokens: DataFrame) -> DataFrame:
    """(seq, ids_crc32): the crc32 of each row's ids as little-endian unsigned 32-bit numbers."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            at = lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums, pa.int64())], ["seq", "ids_crc32"]
            )

    return tokens.select("seq", "tokens").mapInArrow(run, "seq long, ids_crc32 long")
