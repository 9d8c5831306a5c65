"""Target-distribution importance resampling over hashed runs of words.

A document's features are all its runs of one to three words; a feature's bucket is the
CRC-32 of its bytes modulo ``BUCKETS``. Bucket totals of the documents and of a target give
each bucket a gain, a document weighs the sum of its features' gains, and a draw by Gumbel
noise that follows from the document's id takes the highest scores.

Head and tail. Words that make up at least one in ``RARITY`` of all words are the head: at
most ``RARITY`` words can be that frequent, whatever the corpus, which bounds what is
broadcast. For each, the state of the CRC after the word and after a blank and the word are
broadcast; for the pairs of the ``PAIRED`` most frequent of them, the state after the pair.
A run of head words is put together from these states, as CRC-32 is linear: the state after
more bytes is the earlier state moved on by their number, xor their own state. Words outside
the head get their states by a direct CRC, in the slice of text where they stand; runs with
a word of over ``LONGEST`` bytes are summed directly, byte by byte. All features count, and
all counts are exact.

Cases: null and empty texts have no features, weight 0, and are never drawn, as they have
fewer than ``least_words`` words. A null id has a null score and is not drawn. Repeated rows
are scored and ranked each; equal scores go by the smaller id. Extra columns are left out.
An empty table gives an empty table; an empty target has totals of 0.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmosaic.llm.common import batch_of, partitions, text_slices, written
from fieldmosaic.llm.terms import raw_text, words

BUCKETS = 10_000
#: The head: words that are at least one in so many of all words.
RARITY = 50_000
#: Of the head, so many words have the states of their pairs broadcast.
PAIRED = 1024
#: Bytes of a word up to which states are moved on by table.
LONGEST = 64
#: Different words that a task counts before it hands them on.
_HELD = 200_000

_COUNT = pa.schema([("word", pa.binary()), ("n", pa.int64())])
_CELL = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
_WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


class Head(NamedTuple):
    """Frequent words, most frequent first, and the CRC states after two of them."""

    words: list[bytes]
    pairs: np.ndarray  # uint32, PAIRED x PAIRED at most


@lru_cache(maxsize=1)
def _moves() -> np.ndarray:
    """Tables that move a CRC state on by 0 to ``LONGEST + 1`` bytes: length, byte of the
    state, value of this byte."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = np.zeros((LONGEST + 2, 4, 256), np.uint32)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for length in range(LONGEST + 2):
        for byte in range(4):
            out[length, byte] = np.bitwise_xor.reduce(np.where(bits == 1, basis[8 * byte : 8 * byte + 8], np.uint32(0)), axis=1)
        basis = (basis >> np.uint32(8)) ^ step[basis & np.uint32(255)]
    return out


def _followed(state: np.ndarray, own: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after further bytes, of which the own states and numbers are given."""
    moves = _moves()
    moved = moves[length, 0, state & np.uint32(255)]
    for byte in (1, 2, 3):
        moved = moved ^ moves[length, byte, (state >> np.uint32(8 * byte)) & np.uint32(255)]
    return moved ^ own


class _Vocabulary:
    """States of words by number: those of the head, and behind them those of one slice."""

    def __init__(self, head: Head):
        self.head, self.paired = head, len(head.pairs)
        self.number = {w: i for i, w in enumerate(head.words)}
        self.states = self._states(head.words)

    @staticmethod
    def _states(of: list[bytes]) -> tuple[np.ndarray, ...]:
        return (
            np.array([zlib.crc32(w) for w in of], np.uint32),
            np.array([zlib.crc32(b" " + w) for w in of], np.uint32),
            np.array([len(w) + 1 for w in of], np.int64),
        )

    def crcs(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The CRC of each word, of each with the next and of each with the next two."""
        number, tail = self.number, {}
        ids = np.fromiter((number[w] if w in number else tail.setdefault(w, len(number) + len(tail)) for w in tokens), np.int64, len(tokens))
        alone, after, length = (np.concatenate(x) for x in zip(self.states, self._states(list(tail)), strict=True))
        one = alone[ids]
        a, b = ids[:-1], ids[1:]
        two = _followed(one[:-1], after[b], np.minimum(length[b], LONGEST + 1))
        known = (a < self.paired) & (b < self.paired)
        two[known] = self.head.pairs[a[known], b[known]]
        for i in np.nonzero(length[b] > LONGEST + 1)[0]:
            two[i] = zlib.crc32(b" " + tokens[i + 1], int(one[i]))
        c = ids[2:]
        three = _followed(two[:-1], after[c], np.minimum(length[c], LONGEST + 1))
        for i in np.nonzero(length[c] > LONGEST + 1)[0]:
            three[i] = zlib.crc32(b" " + tokens[i + 2], int(two[i]))
        return one, two, three


def _features(vocabulary: _Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and for runs of one, two and three words the places where a run
    begins, of all words, and the bucket of each."""
    split = [words(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    tokens = [w for text in split for w in text]
    text_of = np.repeat(np.arange(len(texts)), counts)
    found = []
    for n, crc in enumerate(vocabulary.crcs(tokens) if tokens else (np.zeros(0, np.uint32),) * 3):
        inside = np.nonzero(text_of[: len(crc)] == text_of[n : n + len(crc)])[0]
        found.append((inside, (crc[inside] % np.uint32(BUCKETS)).astype(np.int64)))
    return counts, found


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` (bytes), ``n`` over all texts; each task counts before it hands on."""

    def count(batches):
        seen: dict[bytes, int] = {}
        for batch in batches:
            for _, texts in text_slices([batch], "raw"):
                for t in texts:
                    for w in words(t):
                        seen[w] = seen.get(w, 0) + 1
                if len(seen) >= _HELD:
                    yield batch_of(_COUNT, [list(seen), list(seen.values())])
                    seen.clear()
        if seen:
            yield batch_of(_COUNT, [list(seen), list(seen.values())])

    rows = docs.select(raw_text(text).alias("raw")).mapInArrow(count, "word binary, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def head_of(docs: DataFrame, text: str = "text") -> Head:
    """The frequent words of all texts: at most ``RARITY`` of at most ``LONGEST`` bytes."""
    counts = written(word_counts(docs, text), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where((F.col("n") * RARITY >= total) & (F.octet_length("word") <= LONGEST)).toArrow()
    found = sorted(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    names = [bytes(w) for w, _ in found]
    alone, after, length = _Vocabulary._states(names[:PAIRED])
    n = len(alone)
    pairs = _followed(np.repeat(alone, n), np.tile(after, n), np.tile(length, n)).reshape(n, n)
    return Head(names, pairs)


def bucket_totals(docs: DataFrame, head: Head, text: str = "text") -> np.ndarray:
    """Features of all texts per bucket; ``BUCKETS`` numbers, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def count(batches):
        vocabulary, cells = _Vocabulary(shared.value), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in text_slices([batch], "raw"):
                for _, buckets in _features(vocabulary, texts)[1]:
                    cells += np.bincount(buckets, minlength=BUCKETS)
        used = np.nonzero(cells)[0]
        yield batch_of(_CELL, [used.astype(np.int32), cells[used]])

    rows = docs.select(raw_text(text).alias("raw")).mapInArrow(count, "bucket int, n bigint")
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[np.asarray(got.column("bucket"))] = np.asarray(got.column("n"))
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array(
        [math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def weigh(docs: DataFrame, head: Head, gain: np.ndarray, text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` per document."""
    shared = docs.sparkSession.sparkContext.broadcast((head, gain))

    def weighed(batches):
        head, gain = shared.value
        vocabulary = _Vocabulary(head)
        for batch in batches:
            for part, texts in text_slices([batch], "raw"):
                counts, runs = _features(vocabulary, texts)
                sums = np.zeros(int(counts.sum()) + 1, np.int64)
                for begin, buckets in runs:  # a run begins once at a word
                    sums[begin + 1] += gain[buckets]
                ends = np.cumsum(counts)
                sums = np.cumsum(sums)
                n_features = counts + np.maximum(counts - 1, 0) + np.maximum(counts - 2, 0)
                yield batch_of(_WEIGHED, [part.column(0), counts, n_features, sums[ends] - sums[ends - counts]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(text).alias("raw"))
    return rows.mapInArrow(weighed, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def scored(weighed: DataFrame, seed: int = 42) -> DataFrame:
    """Adds ``score``: the weight and Gumbel noise that follows from seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise.cast("long"))


def ranked(rows: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """Adds ``rank`` (1 on) to the drawn documents: of those with at least ``least_words``
    words and a score, ``percent`` in a hundred, highest scores first.

    Rows go to ranges of (score, id), so that equal scores part by their ids, and are numbered
    in their range; the counts of the ranges, one row each, give the ranks before them.
    """
    spark = rows.sparkSession
    usable = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    order = [F.desc("usable"), F.desc("score"), F.asc("doc_id")]
    place = F.monotonically_increasing_id()
    dealt = (
        rows.withColumn("usable", usable)
        .repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .withColumns({"part": F.shiftright(place, 33), "at": place.bitwiseAND((1 << 33) - 1)})
    )
    table = written(dealt, "ranges")
    sums = table.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("usable").alias("u"))
    before = sums.select(
        "part",
        (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"),
        F.floor(F.sum("u").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * percent / 100).alias("draw"),
    )
    number = F.col("base") + F.col("at") + 1
    return table.join(before, "part").withColumn("rank", F.when(F.col("usable") & (number <= F.col("draw")), number)).drop("part", "at", "usable", "base", "draw")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``;
    ``target`` has a column ``text``, too."""
    head = head_of(docs)
    gain = gains(bucket_totals(docs, head), bucket_totals(target, head))
    # written first, as finding the ranges reads the scores once more
    return ranked(written(scored(weigh(docs, head, gain), seed), "weighed"), percent, least_words)


def brute_force(docs: list[tuple[int, str | None]], target: list[str | None], percent: int = 5, least_words: int = 20, seed: int = 42) -> dict:
    """The same for a few texts, one feature after the other; for tests."""
    import hashlib
    import re

    def of(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        runs = [" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]
        return len(found), [zlib.crc32(r.encode()) % BUCKETS for r in runs]

    totals = []
    for texts in ([t for _, t in docs], target):
        cells = [0] * BUCKETS
        for t in texts:
            for b in of(t)[1]:
                cells[b] += 1
        totals.append(cells)
    s_all, t_all = (sum(x) + BUCKETS for x in totals)
    gain = [math.floor(1000 * math.log(((t + 1) * s_all) / ((s + 1) * t_all))) for s, t in zip(*totals, strict=True)]
    out, able = {}, []
    for i, t in docs:
        n, found = of(t)
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if n >= least_words:
            able.append((-out[i][2], i))
    for rank, (_, i) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(v) for i, v in out.items()}
