"""Document fingerprints by locally consistent parsing.

A text is a row of names, first its code points. One level up, runs of a name become one
name; deterministic coin tossing reduces names to labels below eight that differ between
neighbours (each round keeps the lowest bit in which a label differs from its left
neighbour, and where that bit is); blocks start at the local maxima of the labels, at
least two and on average about three names apart; a block's new name is a hash of the
names in it. A block depends on a few names around it and on no offset, so equal
substrings have equal names inside, wherever they stand.

The fingerprint holds, for each level apart, the ``KEPT`` smallest hashes of the distinct
phrase names there, from the longest phrases (of about thirty characters) to the shortest.
Two fingerprints are held against each other on the first level where both have ``ENOUGH``
names, or else on that of the shortest phrases. Their likeness is the share of common names
among the smallest of both together: 1 for equal texts, also for two empty ones, and near
0 for unrelated ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmosaic.llm.common import batch_of, offsets_of, partitions, text_slices, whole_text, written

LEVEL = 3
KEPT = 48
ENOUGH = 16
_ROUNDS = 3
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ONE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x ^= x >> np.uint64(27)
    x *= _C
    return x ^ (x >> np.uint64(31))


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Small labels, unlike between neighbours of one text."""
    label = names
    for _ in range(_ROUNDS):
        differs = label.copy()
        differs[1:] ^= label[:-1]
        low = differs & (~differs + _ONE)
        new = np.bitwise_count(low - _ONE) * np.uint8(2) + ((label & low) != 0)
        new[first] = (label[first] & _ONE).astype(np.uint8)
        label = new if _ == _ROUNDS - 1 else new.astype(np.uint64)
    return label


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: block names, and which of them are the first of a text. ``first`` marks
    the first names of texts that stand one behind the other."""
    start = np.ones(len(names), bool)
    start[1:] = (names[1:] != names[:-1]) | first[1:]
    at = np.flatnonzero(start)
    if len(at) < len(names):
        run = np.diff(np.append(at, len(names))).astype(np.uint64)
        names, first = names[at], first[at]
        names = np.where(run > 1, _mix(names + run * _A), names)
    label = _labels(names, first)
    cut = first.copy()
    inner = label[1:-1]
    cut[1:-1] |= (inner > label[:-2]) & (inner > label[2:]) & ~first[2:]
    at = np.flatnonzero(cut)
    length = np.diff(np.append(at, len(names)))
    place = np.arange(len(names)) - np.repeat(at, length)
    sums = np.add.reduceat(_mix(names + place.astype(np.uint64) * _A), at)
    return _mix(sums + length.astype(np.uint64)), first[at]


#: Ascending 32-bit numbers for each level, the longest phrases first.
Sketch = tuple[np.ndarray, ...]


def sketches(texts: list[str]) -> list[Sketch]:
    """Fingerprints of texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    filled = np.flatnonzero(lengths)
    none = np.zeros(0, np.uint32)
    if not len(filled):
        return [(none,) * LEVEL] * len(texts)
    names = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.zeros(len(names), bool)
    first[offsets_of(lengths[filled])[:-1]] = True
    levels = []
    for depth in range(LEVEL):
        names, first = parse(names, first)
        of = (np.cumsum(first) - 1).astype(np.uint64)
        shift = np.uint64((depth + 1) * int(_A) % (1 << 64))
        keys = np.unique((of << np.uint64(32)) | (_mix(names + shift) >> np.uint64(32)))
        bounds = offsets_of(np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(filled)))
        values = keys.astype(np.uint32)
        out = [none] * len(texts)
        for i, a, b in zip(filled, bounds, bounds[1:], strict=False):
            out[i] = values[a : min(b, a + KEPT)].copy()
        levels.append(out)
    return list(zip(*reversed(levels), strict=True))


def likeness(one: Sketch, other: Sketch) -> float:
    a, b = next((pair for pair in zip(one, other, strict=True) if min(map(len, pair)) >= ENOUGH), (one[-1], other[-1]))
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    limit = np.flatnonzero(new)[:KEPT]
    twice = np.append(~new[1:], False)[limit]
    return float(twice.sum() / len(limit))


def text_of(sketch: Sketch) -> str:
    """Hexadecimal digits, with a point between levels."""
    return ".".join(values.astype(">u4").tobytes().hex() for values in sketch)


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars``, ``fingerprint`` of every row. A null text is an empty one;
    repeated rows repeat; extra columns are left out."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for rows, texts in text_slices(batches):
            yield batch_of(schema, [rows.column(0), [len(t) for t in texts], [text_of(s) for s in sketches(texts)]])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


#: Bytes of packed texts that are worked on at once: some times as many of text.
PACKED_SLICE = 300_000
_PACKED = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("packed", pa.binary())])
_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("part", pa.int64()), ("end", pa.string()), ("text", pa.string()),
    ]
)
_RESULT_DDL = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, part bigint, end string, text string"
)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(ids: list, texts: list[str]) -> list[list]:
    """Rows of results for all but the last of consecutive documents."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    own, new = sketches(texts), sketches(changed)
    return [
        [i, len(t), hashlib.sha256(e.encode()).hexdigest(), text_of(a), text_of(x), likeness(a, x), likeness(a, b), None, None, None]
        for i, t, e, a, x, b in zip(ids, texts, changed, own, new, own[1:], strict=False)
    ]


def _rows(rows: list[list]) -> pa.RecordBatch:
    return batch_of(_RESULT, list(map(list, zip(*rows, strict=True))) if rows else [[] for _ in _RESULT])


def neighbours(docs: DataFrame) -> DataFrame:
    """Every document beside the next one in descending ``doc_id`` (the first after the
    last), ties by a hash of the text, nulls last: the fingerprints of its text and its edited text, and
    how near they are.

    Documents move once, by ranges of their ids, with their texts packed. A task compares what follows each other in
    its range and leaves the range's first and last document to a second step, which joins
    them over the ranges: two rows for each partition. One document is its own next one.
    """

    def within(batches):
        part, last, begun = TaskContext.get().partitionId(), None, False
        unpack = zstandard.ZstdDecompressor()
        for rows, packed in text_slices(batches, "packed", PACKED_SLICE):
            ids, texts = rows.column(0).to_pylist(), [unpack.decompress(p).decode() for p in packed]
            if not begun:
                yield _rows([[ids[0], *[None] * 6, part, "head", texts[0]]])
                begun = True
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = ids[-1], texts[-1]
            yield _rows(_compared(ids, texts))
        if begun:
            yield _rows([[last[0], *[None] * 6, part, "tail", last[1]]])

    def across(batches):
        for batch in batches:
            for i, t, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield _rows(_compared([i], [t, b]))

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for rows, texts in text_slices(batches):
            yield batch_of(_PACKED, [rows.column(0), rows.column(2), [packer.compress(t.encode()) for t in texts]])

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
        .select("doc_id", "text", F.xxhash64("text").alias("tie"))
        .mapInArrow(pack, "doc_id bigint, tie bigint, packed binary")
        .repartitionByRange(partitions(docs.sparkSession), F.desc("doc_id"))
        .sortWithinPartitions(F.desc("doc_id"), F.desc("tie"))
    )
    found = written(ordered.mapInArrow(within, _RESULT_DDL), "fingerprints")
    # one number per partition that has rows
    heads = found.where("end = 'head'").select("part", "text")
    order = Window.orderBy("part")
    following = (
        heads.select("part", F.lead("part").over(order).alias("after"), F.first("part").over(order).alias("top"))
        .select(F.col("part").alias("tail_part"), F.coalesce("after", "top").alias("part"))
    )
    tails = found.where("end = 'tail'").select("doc_id", F.col("part").alias("tail_part"), F.col("text").alias("own"))
    ends = tails.join(following, "tail_part").join(heads, "part").select("doc_id", "own", "text")
    return found.where("end IS NULL").unionByName(ends.mapInArrow(across, _RESULT_DDL)).drop("part", "end", "text")
