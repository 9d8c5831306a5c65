"""Pieces that several corpus operators share."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmosaic.session import new_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: ASCII white space; everything else belongs to a word.
WHITE = r"[\x20\x09-\x0D]+"
#: Characters of text that a Python task works on at once.
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of tables. Python workers on this machine find the package
    where the driver does; a cluster gets it by ``--py-files``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def whole_text(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many more lines in front as it takes to be no column's."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read again, so that neither a
    later action nor a lost executor computes it anew."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut into runs of rows with at most ``chars`` bytes of text each (one
    row at least), with the texts as a list. Memory follows the slice and the longest text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
        ends = np.cumsum(sizes)
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + chars, side="right")))
            part = batch.slice(low, high - low)
            yield part, column.slice(low, high - low).to_pylist()
            low = high


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[starts[i] : starts[i] + lengths[i]]`` one behind the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def int_lists(flat: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets_of(lengths).astype(np.int32)), pa.array(flat.astype(np.int32)))


def batch_of(schema: pa.Schema, columns: Sequence[object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
