"""Ranked lexical search: exact inner products over ball trees of sparse documents.

A document is a sparse vector over the terms of the stated queries: the integer worth of a
term in this document, from its occurrences and the document's length. A query is the
vector of its terms' weights, and a score the inner product of both, an exact integer.

Tasks cut their documents into blocks of at most ``BLOCK_DOCS`` documents and ``BLOCK_CELLS``
entries and build a ball tree over each: a node holds the centroid of its documents and the
largest distance of one from it, in coordinates scaled by the terms' weights. No document
below a node can score more than centroid product + query length x radius, where the length
is that of the terms which occur below the node. The search opens
the node with the highest bound first and ends once no bound reaches the least score still
among the query's best; leaves are scored in integers. Bounds are worked out in doubles and
widened by more than these can be off, so rounding loses nothing. The best of a task's
earlier blocks go on as the floor of the later ones, and a task hands on ``k`` rows a query
at most.

Queries go in blocks whose terms are counted over all documents and then searched for; a
block's size is bounded, the number of blocks follows the query table.

Cases: null and empty texts hold no terms, count nowhere and are never found. Rows of one
document id are documents of their own, and so are rows of one item id (equal ones are
searched for once and their rows repeated); a null id is kept
and orders first. Items without terms, and items whose terms no document holds, have no
rows. Equal scores go by the smaller document id. Extra columns are left out. An empty
table on either side gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldmosaic.llm.common import batch_of, offsets_of, partitions, ragged, text_slices, written
from fieldmosaic.llm.terms import raw_text, words

#: Queries of a block: items, by whose number the table is cut, and documents of a tree.
BLOCK_ITEMS, BLOCK_DOCS, BLOCK_CELLS, LEAF_DOCS = 1000, 8192, 2_000_000, 48
#: Cells of a tree's centroid matrix: bounds the memory of trees over very many terms.
CENTROID_CELLS = 4_000_000
#: What a bound is widened by: far more than the rounding of sums of doubles.
SLACK = 1e-9

_HIT = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_COUNT = pa.schema([("term", pa.int32()), ("n", pa.int64())])


class Items(NamedTuple):
    """A block of queries: ids, how often each occurs, term numbers of each, and the terms."""

    ids: list[int | None]
    times: list[int]
    terms: list[np.ndarray]
    number: dict[bytes, int]


class Docs(NamedTuple):
    """Documents as rows of (term, value) entries, in CSR form, terms ascending."""

    ids: np.ndarray
    nulls: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray


def _counted(texts: list[bytes], number: dict[bytes, int]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Terms per text with repeats, and in order of (text, term): text, term, occurrences."""
    lengths, found, of = [], [], []
    for i, text in enumerate(texts):
        tokens = words(text)
        lengths.append(len(tokens))
        hits = [number[w] for w in tokens if w in number]
        found += hits
        of.append(np.full(len(hits), i, np.int64))
    size = max(len(number), 1)
    keys, n = np.unique(np.concatenate([*of, np.zeros(0, np.int64)]) * size + np.array(found, np.int64), return_counts=True)
    return lengths, keys // size, keys % size, n.astype(np.int64)


def corpus_counts(docs: DataFrame, items: Items, text: str = "text") -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents with each query term,
    in one pass; every task hands on a count per term."""
    shared = docs.sparkSession.sparkContext.broadcast(items.number)

    def count(batches):
        number = shared.value
        cells, n, total = np.zeros(len(number), np.int64), 0, 0
        for batch in batches:
            for _, texts in text_slices([batch], "raw"):
                lengths, _, terms, _ = _counted(texts, number)
                cells += np.bincount(terms, minlength=len(number))
                n += sum(map(bool, lengths))
                total += sum(lengths)
        used = np.nonzero(cells)[0]
        yield batch_of(_COUNT, [np.append(used, [-1, -2]).astype(np.int32), np.append(cells[used], [n, total])])

    rows = docs.select(raw_text(text).alias("raw")).mapInArrow(count, "term int, n bigint")
    got = rows.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(got.column("term").to_pylist(), got.column("n").to_pylist(), strict=True))
    df = np.array([found.get(i, 0) for i in range(len(items.number))], np.int64)
    return found.get(-1, 0), found.get(-2, 0), df


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log(float(2 * n_docs + 2) / float(2 * d + 1))) for d in df.tolist()], np.int64)


def _values(lengths: list[int], rows: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term is worth in its document, the longer the document the less."""
    m = np.array([50 + 50 * n * n_docs // max(n_terms, 1) for n in lengths], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m[rows])


class BallTree:
    """Centroids and radii over one block of documents, in scaled coordinates.

    ``scale`` is a positive factor for each term. Documents are reordered so that each node
    holds a run of them; nodes stand in ``low, high, left, right`` (-1 for a leaf).
    """

    def __init__(self, docs: Docs, scale: np.ndarray, leaf: int = LEAF_DOCS):
        n = len(docs.ids)
        used, local = np.unique(docs.terms, return_inverse=True)
        self.used, lengths = used, np.diff(docs.starts)
        leaf = max(leaf, -(-2 * n * len(used) // CENTROID_CELLS))
        weighted = docs.values * scale[docs.terms]
        norms = np.add.reduceat(np.append(weighted**2, 0.0), docs.starts[:-1]) * (lengths > 0) if n else np.zeros(0)
        order = np.arange(n)
        low, high, left, right, centroids, radii = [], [], [], [], [], []

        def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = ragged(np.arange(len(local)), docs.starts[rows], lengths[rows])
            return np.repeat(np.arange(len(rows)), lengths[rows]), local[at], weighted[at]

        def products(row: np.ndarray, column: np.ndarray, value: np.ndarray, dense: np.ndarray, count: int) -> np.ndarray:
            return np.bincount(row, weights=value * dense[column], minlength=count)

        stack = [(0, n, -1, False)]
        while stack:
            a, b, parent, is_right = stack.pop()
            node, rows = len(low), order[a:b]
            row, column, value = entries(rows)
            centre = np.bincount(column, weights=value, minlength=len(used)) / max(b - a, 1)
            square = norms[rows] - 2 * products(row, column, value, centre, b - a) + centre @ centre
            # cancellation leaves an error below this share of the squares that went in
            most = float(np.max(np.maximum(square, 0) + SLACK * (norms[rows] + centre @ centre), initial=0))
            low.append(a), high.append(b), left.append(-1), right.append(-1)
            centroids.append(centre), radii.append(math.sqrt(most))
            if parent >= 0:
                (right if is_right else left)[parent] = node
            if b - a <= leaf or most <= 2 * SLACK * float(np.max(norms[rows], initial=0)):
                continue
            # two far documents; the others go by which is nearer, ties and all-alike by halves
            def dense(i: int) -> np.ndarray:
                out = np.zeros(len(used))
                span = slice(docs.starts[i], docs.starts[i + 1])
                out[local[span]] = weighted[span]
                return out

            one = dense(rows[int(np.argmax(square))])
            far = norms[rows] - 2 * products(row, column, value, one, b - a)
            two = dense(rows[int(np.argmax(far))])
            side = products(row, column, value, two - one, b - a) - (two @ two - one @ one) / 2
            sort = np.argsort(side, kind="stable")
            cut = int(np.searchsorted(side[sort], 0, side="right"))
            if not (b - a) // 16 <= cut <= (b - a) - (b - a) // 16:
                cut = (b - a) // 2
            order[a:b] = rows[sort]
            stack += [(a, a + cut, node, False), (a + cut, b, node, True)]
        self.order, self.low, self.high, self.left, self.right = order, low, high, left, right
        self.centroids, self.radii = np.array(centroids).T.copy(), np.array(radii)
        self.starts = offsets_of(lengths[order])
        at = ragged(np.arange(len(local)), docs.starts[order], lengths[order])
        self.terms, self.values = local[at], docs.values[at]
        self.ids = docs.ids[order]

    def bounds(self, terms: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """For each node, a number that no scaled inner product with its documents exceeds."""
        where = np.searchsorted(self.used, terms)
        known = (where < len(self.used)) & (self.used[np.minimum(where, len(self.used) - 1)] == terms) if len(self.used) else np.zeros(len(terms), bool)
        f, centres = factors[known], self.centroids[where[known]] if known.any() else np.zeros((0, len(self.radii)))
        # terms that no document below a node holds lengthen no inner product with one of them
        length = np.sqrt((f * f) @ (centres > 0))
        return (f @ centres + length * self.radii) * (1 + SLACK) + 1

    def search(self, terms: np.ndarray, factors: np.ndarray, weights: np.ndarray, best: "Best", scratch: np.ndarray) -> int:
        """Offer every document that may be among the ``best``; returns the leaves opened."""
        bound = self.bounds(terms, factors)
        inside = terms[np.isin(terms, self.used, assume_unique=True)]
        columns = np.searchsorted(self.used, inside)
        scratch[columns] = weights[inside]
        heap, opened = [(-bound[0], 0)], 0
        while heap:
            most, node = heapq.heappop(heap)
            if -most < best.least():
                break
            if self.left[node] < 0:
                opened += 1
                a, b = self.low[node], self.high[node]
                span = slice(self.starts[a], self.starts[b])
                parts = np.zeros(self.starts[b] - self.starts[a] + 1, np.int64)
                np.cumsum(self.values[span] * scratch[self.terms[span]], out=parts[1:])
                ends = self.starts[a : b + 1] - self.starts[a]
                scores = parts[ends[1:]] - parts[ends[:-1]]
                best.offer(scores, self.order[a:b])
            else:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (max(most, -bound[child]), child))
        scratch[columns] = 0
        return opened


class Best:
    """The ``k`` best (score, id) of a query so far, scores above 0 only."""

    def __init__(self, k: int):
        self.k, self.rows = k, []  # (score descending, null first, id ascending)
        self.ids = self.nulls = None

    def over(self, ids: np.ndarray, nulls: np.ndarray) -> "Best":
        self.ids, self.nulls = ids, nulls
        return self

    def least(self) -> int:
        return -self.rows[-1][0] if len(self.rows) >= self.k else 1

    def offer(self, scores: np.ndarray, places: np.ndarray) -> None:
        good = np.nonzero(scores >= self.least())[0]
        if len(good):
            at = places[good]
            new = zip((-scores[good]).tolist(), (~self.nulls[at]).tolist(), self.ids[at].tolist(), strict=True)
            self.rows = sorted([*self.rows, *new])[: self.k]


def _blocks(batches, number: dict[bytes, int], n_docs: int, n_terms: int) -> Iterator[Docs]:
    """Documents with a query term, in blocks of bounded size."""
    ids: list[np.ndarray] = []
    nulls: list[np.ndarray] = []
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    docs = cells = 0

    def joined() -> Docs:
        counts, terms, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        return Docs(np.concatenate(ids), np.concatenate(nulls), offsets_of(counts), terms, values)

    for batch in batches:
        for part, texts in text_slices([batch], "raw"):
            lengths, rows, terms, tf = _counted(texts, number)
            values = _values(lengths, rows, tf, n_docs, n_terms)
            used, counts = np.unique(rows, return_counts=True)
            column = part.column(0)
            ids.append(np.asarray(column.fill_null(0))[used])
            nulls.append(np.asarray(column.is_null())[used])
            parts.append((counts, terms, values))
            docs, cells = docs + len(used), cells + len(terms)
            if docs >= BLOCK_DOCS or cells >= BLOCK_CELLS:
                yield joined()
                ids, nulls, parts, docs, cells = [], [], [], 0, 0
    if docs:
        yield joined()


def search_block(docs: DataFrame, items: Items, k: int, text: str = "text") -> DataFrame:
    """``item`` (number in the block), ``doc_id``, ``score``: the best of each task."""
    spark = docs.sparkSession
    n_docs, n_terms, df = corpus_counts(docs, items, text)
    weights = term_weights(n_docs, df)
    shared = spark.sparkContext.broadcast((items, weights, n_docs, n_terms))

    def search(batches):
        items, weights, n_docs, n_terms = shared.value
        # scaled by its weight, a term counts in a distance as it counts in a score
        scale = np.maximum(weights, 1).astype(float)
        best = [Best(k) for _ in items.ids]
        scratch = np.zeros(len(weights) + 1, np.int64)
        for block in _blocks(batches, items.number, n_docs, n_terms):
            tree = BallTree(block, scale)
            for terms, mine in zip(items.terms, best, strict=True):
                tree.search(terms, weights[terms] / scale[terms], weights, mine.over(block.ids, block.nulls), scratch)
        for i, mine in enumerate(best):
            if mine.rows:
                found = pa.array([None if not known else d for _, known, d in mine.rows], pa.int64())
                yield batch_of(_HIT, [np.full(len(mine.rows), i, np.int64), found, np.array([-s for s, _, _ in mine.rows], np.int64)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(text).alias("raw"))
    return rows.mapInArrow(search, "item bigint, doc_id bigint, score bigint")


def _item_blocks(queries: DataFrame, item: str, text: str) -> Iterator[Items]:
    """The different queries in blocks of about ``BLOCK_ITEMS``, dealt by their hash."""
    rows = queries.select(F.col(f"`{item}`").cast("long").alias("item_id"), raw_text(text).alias("raw"))
    table = written(rows.groupBy("item_id", "raw").agg(F.count(F.lit(1)).alias("times")), "items")
    blocks = max(1, -(-table.count() // BLOCK_ITEMS))
    for i in range(blocks):
        rows = table.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(blocks)) == i).toArrow()
        number: dict[bytes, int] = {}
        terms = [
            np.unique(np.array([number.setdefault(w, len(number)) for w in words(raw)], np.int64))
            for raw in rows.column("raw").to_pylist()
        ]
        yield Items(rows.column("item_id").to_pylist(), rows.column("times").to_pylist(), terms, number)


def rank(docs: DataFrame, queries: DataFrame, k: int = 50, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each query, by score and
    then id. The best of the tasks meet in two steps, by item and a slice of the ids and then
    by item, so that no task sorts the rows of all tasks for one item."""
    spark = docs.sparkSession
    out = None
    for items in _item_blocks(queries, item, text):
        hits = search_block(docs, items, k, text)
        slices = F.pmod(F.xxhash64("doc_id"), F.lit(partitions(spark)))
        order = [F.desc("score"), F.asc("doc_id")]
        first = Window.partitionBy("item", slices).orderBy(*order)
        last = Window.partitionBy("item").orderBy(*order)
        few = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        top = few.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
        ids = spark.createDataFrame(list(zip(range(len(items.ids)), items.ids, items.times, strict=True)), "item bigint, item_id bigint, times bigint")
        named = top.join(F.broadcast(ids), "item").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
        named = named.select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    return written(out, "ranked")


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], k: int = 50) -> list[tuple[int, int, int, int]]:
    """The same for a few texts, document by document; for tests."""
    import re

    def of(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)

    held = [(i, of(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df: dict[str, int] = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        rows = []
        for i, t in held:
            m = 50 + 50 * len(t) * n_docs // total if t else 0
            score = 0
            for w in set(of(text)) & set(t):
                tf = t.count(w)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                rows.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return out


#: The rows of the query ``op13_ranked_search`` in SQL.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms
  FROM documents),
size AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
tf AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (
  SELECT DISTINCT row, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM (SELECT row_number() OVER () AS row, item_id, text FROM benchmark)),
s AS (
  SELECT q.row AS item, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
         sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(terms) * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN d ON d.row = tf.row, size
  GROUP BY q.row, d.row),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""
