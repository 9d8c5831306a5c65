"""Token ids in ORC files, in ascending document order, and readers of these files.

Each file holds one contiguous range of document ids. Lists of ids are integer streams of
run-length encoding; every stripe has row indexes and a Bloom filter on ``doc_id``, so
readers split a file by stripes and a search opens only row groups that may hold its ids.

Rows: ``part`` (number of the file in document order), ``first`` (ids of the part's
earlier documents), ``doc_id``, ``n_tokens``, ``ids``. A null text is an empty one and has
the end id alone; null document ids come first; rows of one document id go by text, and
equal rows are written as often as they come. Extra columns are left out. An empty table
writes files without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmosaic.llm.common import batch_of, int_lists, offsets_of, partitions, text_slices, whole_text
from fieldmosaic.llm.tokens import encoder

_ROW = pa.schema(
    [("part", pa.int32()), ("first", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]
)
_ROW_DDL = "part int, first bigint, doc_id bigint, n_tokens bigint, ids array<int>"
_DIGEST = pa.schema(
    [("part", pa.int32()), ("first", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, files: int | None = None, stripe_mb: int = 16
) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) and write the ids to ``path``.

    Texts, not ids, are dealt out by ranges, so that finding the ranges reads ids of
    documents and encodes nothing. ``tokenizer`` must be readable on every executor.
    """

    def encode(batches):
        part, first = TaskContext.get().partitionId(), 0
        for rows, texts in text_slices(batches):
            ids, counts = encoder(tokenizer).encode(texts, end_id)
            starts = first + np.cumsum(counts) - counts
            first += len(ids)
            yield batch_of(_ROW, [np.full(len(texts), part, np.int32), starts, rows.column(0), counts, int_lists(ids, counts)])

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
        .repartitionByRange(files or partitions(docs.sparkSession), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, _ROW_DDL)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_mb << 20)
        .option("orc.row.index.stride", 1000)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROW_DDL).orc(path)


def find_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of given documents; stripes and row groups are skipped by their metadata."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(doc_ids))


def part_bases(tokens: DataFrame) -> DataFrame:
    """``part``, ``base``: ids in all earlier files. Reads two narrow columns; the window
    holds one row per file."""
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``, all from the files."""

    def digest(batches):
        for batch in batches:
            lists = batch.column(4)
            ids = np.asarray(lists.flatten()).astype("<u4")
            ends = offsets_of(np.asarray(pc.list_value_length(lists)))
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield batch_of(_DIGEST, [*batch.columns[:3], np.diff(ends), np.array(sums, np.int64)])

    tokens = read_tokens(spark, path)
    rows = tokens.mapInArrow(digest, "part int, first bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(part_bases(tokens), "part").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )
