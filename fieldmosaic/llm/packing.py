"""Packing of documents into sequences, shortest pack first over the length histogram.

Documents are cut every ``size`` ids. The histogram of piece lengths, at most ``size``
numbers however large the corpus, is placed longest length first, each into the shortest
pack that exists while it fits and into new packs otherwise. Packs with one filling are
one group of consecutive sequence numbers, so a placement is one row: the pieces of a
length with ranks in a range go to consecutive sequences at one offset. Pieces find their
sequence by their length and their rank among the pieces of this length.

A null text is an empty one: one piece with the end id alone. Repeated rows are packed as
often as they come; rows of a document id are told apart by a row number. Extra columns
are left out. An empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmosaic.llm.common import batch_of, int_lists, offsets_of, text_slices, whole_text, written
from fieldmosaic.llm.tokens import encoder

SIZE = 4096
_PIECE = [
    ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
]
_PIECE_DDL = "doc_id bigint, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_PLACED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Pieces of one length that are ranked in one task.
RANKED = 100_000


def cut(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = SIZE, keep_ids: bool = True) -> DataFrame:
    """Encode ``docs`` and cut each document every ``size`` ids: ``doc_id``, ``row`` (of the
    document's row), ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, if kept, ``ids``."""
    schema = pa.schema([*_PIECE, *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])

    def pieces(batches):
        row = TaskContext.get().partitionId() << 33
        for rows, texts in text_slices(batches):
            ids, counts = encoder(tokenizer).encode(texts, end_id)
            n = -(-counts // size)
            of = np.repeat(np.arange(len(texts)), n)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * size
            length = np.minimum(size, counts[of] - start)
            at = offsets_of(length)
            ids = ids.astype("<u4")
            crc = np.array([zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)], np.int64)
            columns = [rows.column(0).take(pa.array(of)), row + of, start, length, crc, counts[of]]
            yield batch_of(schema, columns + ([int_lists(ids, length)] if keep_ids else []))
            row += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        pieces, _PIECE_DDL + (", ids array<int>" if keep_ids else "")
    )


def place(histogram: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Shortest pack first. Rows ``length, rank, count, sequence, offset``: the ``count``
    pieces of ``length`` from ``rank`` on go to the sequences from ``sequence`` on, at
    ``offset``. Groups of packs are at most two per length, so rows depend on ``size``
    alone and not on the number of pieces."""
    groups: list[tuple[int, int, int]] = []  # filled, first sequence, packs
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if groups and groups[0][0] + length <= size:
                filled, first, packs = heapq.heappop(groups)
                n = min(packs, left)
                if packs > n:
                    heapq.heappush(groups, (filled, first + n, packs - n))
            else:
                # as many new packs as the rest fills, not one for each piece
                filled, first, n = 0, sequences, -(-left // (size // length))
                sequences += n
            rows.append((length, rank, n, first, filled))
            if filled + length < size:
                heapq.heappush(groups, (filled + length, first, n))
            rank, left = rank + n, left - n
    return np.array(rows, np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, histogram: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, counted from 0 among the pieces of a length.

    A length is ranked in slices by a hash of the piece, as many as its count asks for, and
    slices follow each other: a length that holds a third of all pieces is spread out.
    """
    key = F.xxhash64("doc_id", "row", "start")
    # one row for each length, so at most ``size`` rows
    slices = histogram.select(F.col("length").alias("of"), F.ceil(F.col("n") / RANKED).alias("slices"))
    sliced = pieces.join(F.broadcast(slices), F.col("length") == F.col("of")).withColumn("slice", F.pmod(key, F.col("slices")))
    counts = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = counts.select(
        F.col("length").alias("of"), F.col("slice").alias("at"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"),
    )
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "row", "start"))
    return (
        sliced.drop("of", "slices").withColumn("within", within)
        .join(before, (F.col("length") == F.col("of")) & (F.col("slice") == F.col("at")))
        .withColumn("rank", F.col("before") + F.col("within") - 1)
        .drop("of", "at", "slice", "within", "before")
    )


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Give every piece its ``sequence_id`` and ``offset``. ``pieces`` is read several times
    and should be a written table."""
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in histogram.collect()}  # at most ``size`` rows
    slots = place(counts, size)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    # lengths and ranks as one ascending number, so that a piece finds its slot by one search
    most = max(counts.values(), default=0) + 1
    heads = slots[:, 0] * most + slots[:, 1]
    names = [f.name for f in _PLACED][:6]

    def assign(batches):
        for b in batches:
            length, rank = np.asarray(b.column(3)), np.asarray(b.column(6))
            slot = slots[np.searchsorted(heads, length * most + rank, side="right") - 1]
            yield batch_of(_PLACED, [*b.columns[:6], slot[:, 3] + rank - slot[:, 1], slot[:, 4]])

    return ranked(pieces.select(names), histogram).select(*names, "rank").mapInArrow(
        assign, _PIECE_DDL + ", sequence_id bigint, offset bigint"
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = SIZE) -> DataFrame:
    """Cut, written once, and packed; one row per piece, without the ids themselves.
    ``cut(docs, ...)`` gives them under the same ``doc_id`` and ``start``."""
    return pack(written(cut(docs, tokenizer, end_id, size, keep_ids=False), "pieces"), size)
