"""N-gram Jaccard self-join through a token-group matrix.

A document's set holds the hashes of its five-word shingles. Documents with one set are a
class and count once. Two classes link when ``100 * common >= 80 * union``; then at least
80 % of either set is common, so with all tokens in one order the first
``n - ceil(0.8 n) + 1`` tokens of both sets share one. Any order is right; the one used puts
frequent tokens last, by a sketch of token counts over the corpus.

* Tokens that come first in two or more classes are live; all others lead nowhere.
* Similar classes of about one size form groups: a token's leader is the least class that
  has it, and a class joins the leader of most of its live tokens. Large groups are split
  into blocks of at most about ``BLOCK_SETS`` sets and ``BLOCK_TOKENS`` tokens.
* The matrix has a row for each live token and block, with the sizes of the sets that have
  the token. Joining a class's live tokens with it counts what the class has in common with
  each block. Two sets have at most as many tokens in common as their first tokens have,
  and all later tokens of the one whose first tokens end earlier; so a block is a candidate
  only if the count makes up for the rest, for the sizes in the block.
* A block's task holds the union of its members' tokens. A class with fewer than 80 % of its
  tokens in the union is turned away; for others the block is opened and exact overlaps with
  all members are counted at once. Links that tell nothing new inside a block (both ends are
  joined already) are left out, so a dense group gives as many rows as members and not as
  their square.

Components of the remaining links join all documents. Null and empty texts, or texts of
white space, have an empty set and no links. Rows without an id have no component. Rows of
one ``doc_id`` are one document, also with different texts. Extra columns are left out.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmosaic.llm.common import batch_of, fresh, offsets_of, ragged, text_slices, whole_text, written
from fieldmosaic.llm.components import components

WORDS = 5
SHARE = 80
BLOCK_SETS = 256
BLOCK_TOKENS = 200_000
#: Cells of the sketch of token counts, and cells of it that are told apart as frequent.
CELLS = 1 << 22
FREQUENT = 100_000
_SHIFT = np.uint64(64 - 22)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of texts; word hashes are kept up to ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        self.limit = limit
        self.known = _WordHashes()

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All sets one behind the other, each ascending, and where each begins and ends."""
        if len(self.known) > self.limit:
            self.known.clear()
        words = [t.encode().lower().split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        hashes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
        ends = offsets_of(sizes)
        total = np.zeros(len(hashes), np.uint64)
        for k, odd in enumerate(_ODD):
            total[: len(hashes) - k] += hashes[k:] * odd
        shingles = _mix(total)
        # a shingle starts at each word but a text's last four; a shorter text is one shingle
        counts = np.where(sizes >= WORDS, sizes - WORDS + 1, 0)
        out = []
        for i, n in enumerate(counts):
            if n:
                out.append(np.unique(shingles[ends[i] : ends[i] + n]))
            elif sizes[i]:
                short = hashes[ends[i] : ends[i + 1]]
                value = (short * np.array(_ODD[: len(short)])).sum(keepdims=True) + np.uint64(len(short))
                out.append(_mix(value * _M2))
            else:
                out.append(shingles[:0])
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else shingles[:0]), offsets_of(lengths)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _sums(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums per set that name it, as signed numbers."""
    out = np.zeros((2, len(bounds) - 1), np.uint64)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        for k in range(2):
            out[k, filled] = np.add.reduceat(_mix(tokens * _ODD[k + 1] + _ODD[k]), bounds[:-1][filled])
    return out.view(np.int64)


_SETS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("cell", pa.int32()), ("count", pa.int64())]
)
_PREFIX = pa.schema([("s1", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """A row per document with its set's size and name, and rows (``doc_id`` null, ``cell``
    set) for the cells of the token sketch that stand out in a task."""

    def run(batches):
        shingler, cells = Shingler(), np.zeros(CELLS, np.int32)
        for rows, texts in text_slices(batches):
            tokens, bounds = shingler.sets(texts)
            np.add.at(cells, (tokens >> _SHIFT).astype(np.int64), 1)
            n = len(texts)
            nothing = pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())
            yield batch_of(_SETS, [rows.column(0), np.diff(bounds), *_sums(tokens, bounds), *nothing])
        at = np.flatnonzero(cells >= max(16, 4 * int(cells.sum()) // CELLS))
        nothing = [pa.nulls(len(at), pa.int64())] * 4
        yield batch_of(_SETS, [*nothing, at, cells[at]])

    return _texts(docs).mapInArrow(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, cell int, count bigint")


def _levels(sets: DataFrame) -> np.ndarray:
    """Per cell of the sketch the power of two of its count, 0 unless it is among the
    ``FREQUENT`` largest."""
    counts = sets.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("count").alias("n"))
    rows = counts.orderBy(F.desc("n"), "cell").limit(FREQUENT).toArrow()
    levels = np.zeros(CELLS, np.uint8)
    levels[rows["cell"].to_numpy()] = np.log2(rows["n"].to_numpy()).astype(np.uint8)
    return levels


def prefixes(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """``s1``, ``n``, ``tokens``: the first tokens of each set, rare ones before frequent ones."""
    at = np.flatnonzero(levels)
    sparse = at.astype(np.int32), levels[at]

    def run(batches):
        shingler, level = Shingler(), np.zeros(CELLS, np.uint8)
        level[sparse[0]] = sparse[1]
        for _, texts in text_slices(batches):
            tokens, bounds = shingler.sets(texts)
            n = np.diff(bounds)
            of = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((tokens, level[(tokens >> _SHIFT).astype(np.int64)], of))
            wanted = np.where(n > 0, n - (n * SHARE + 99) // 100 + 1, 0)
            kept = ragged(tokens[order], bounds[:-1], wanted).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets_of(wanted).astype(np.int32)), pa.array(kept))
            yield batch_of(_PREFIX, [_sums(tokens, bounds)[0], n, lists])

    return _texts(docs).mapInArrow(run, "s1 bigint, n bigint, tokens array<bigint>")


def live_tokens(prefix: DataFrame) -> DataFrame:
    """``token``, ``s1``, ``n``, ``leader``: tokens that come first in two or more classes."""
    rows = prefix.select("s1", "n", F.explode("tokens").alias("token"))
    shared = rows.groupBy("token").agg(F.min("s1").alias("leader"), F.max("s1").alias("last")).where("leader < last").drop("last")
    return rows.join(shared, "token").select("token", "s1", "n", "leader").distinct()


def blocks(live: DataFrame) -> DataFrame:
    """``s1``, ``n``, ``block``: each class in one block of similar ones."""
    votes = live.groupBy("s1", "n", "leader").agg(F.count("*").alias("votes"))
    led = votes.groupBy("s1", "n").agg(F.max(F.struct("votes", "leader")).alias("v")).select(
        "s1", "n", F.xxhash64("v.leader", F.floor(F.log("n") / F.log(F.lit(1.12)))).alias("group")
    )
    parts = led.groupBy("group").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("parts")
    )
    return led.join(parts, "group").select("s1", "n", F.xxhash64("group", F.pmod(F.xxhash64("s1"), "parts")).alias("block"))


def _needed(n: Column, low: Column, high: Column) -> Column:
    """Common first tokens that a set of ``n`` needs with one of ``low`` to ``high`` tokens:
    the overlap that a link asks for, less the later tokens of either set. It is least at an
    end of the range; one less for rounding."""

    def of(s: Column) -> Column:
        overlap = F.floor((4 * (n + s) + 8) / 9)
        return overlap - F.greatest(F.floor((4 * n + 4) / 5), F.floor((4 * s + 4) / 5)) + 1

    ends = F.greatest(low, F.ceil(n * 4 / 5)), F.least(high, F.floor(n * 5 / 4))
    return F.greatest(F.lit(1), F.least(*map(of, ends)) - 1)


def candidates(live: DataFrame, block_of: DataFrame) -> DataFrame:
    """``s1``, ``block``, ``member``: the blocks to open with all their members, and the
    classes of other blocks to look up in them. Of two blocks the lesser number looks up in
    the other; looking up in the own block takes another member with the token."""
    placed = live.select("token", "s1").join(block_of, "s1")
    matrix = placed.groupBy("token", F.col("block").alias("other")).agg(
        F.count("*").alias("holders"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    near = (5 * F.col("high") >= 4 * F.col("n")) & (4 * F.col("low") <= 5 * F.col("n"))
    order = (F.col("block") < F.col("other")) | ((F.col("block") == F.col("other")) & (F.col("holders") > 1))
    counted = placed.join(matrix, "token").where(near & order).groupBy("s1", "n", "block", "other").agg(
        F.count("*").alias("common"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    asked = written(counted.where(F.col("common") >= _needed(F.col("n"), F.col("low"), F.col("high"))).select("s1", "block", "other"), "asked")
    opened = asked.select(F.col("other").alias("block")).distinct()
    members = block_of.join(opened, "block").select("s1", "block", F.lit(True).alias("member"))
    guests = asked.where("block <> other").select("s1", F.col("other").alias("block"), F.lit(False).alias("member"))
    return members.union(guests)


class Block:
    """The members' token union with the owners of each token, and what is joined so far."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sizes = list(ids), np.fromiter(map(len, sets), np.int64, len(sets))
        tokens = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owners = owners[order]
        self.union, self.starts, self.counts = np.unique(tokens[order], return_index=True, return_counts=True)
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []
        for i, tokens in enumerate(sets):
            self.ask(i, ids[i], tokens)

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def ask(self, at: int | None, doc: int, tokens: np.ndarray) -> None:
        """Links of a set with the members; ``at``: its own number among them."""
        place = np.searchsorted(self.union, tokens)
        place[place == len(self.union)] = 0
        place = place[self.union[place] == tokens]
        if 100 * len(place) < SHARE * len(tokens):
            return
        common = np.bincount(ragged(self.owners, self.starts[place], self.counts[place]), minlength=len(self.sizes))
        linked = np.flatnonzero(100 * common >= SHARE * (len(tokens) + self.sizes - common))
        if at is None:
            at = len(self.parent)
            self.parent.append(at)
            self.ids.append(doc)
        for other in linked.tolist():
            a, b = self._root(at), self._root(other)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.links.append((doc, self.ids[other]))


def _verified(rows: DataFrame) -> DataFrame:
    """Links from rows (``block``, ``member``, ``doc_id``, ``s1``, ``packed``), a block's rows
    together and its members first."""

    def run(batches):
        shingler, unpack = Shingler(), zstandard.ZstdDecompressor()
        now, block, ids, sets = None, None, [], []
        for number, member, doc, tokens in _unpacked(batches, shingler, unpack):
            if number != now:
                if ids:
                    block = Block(ids, sets)
                if block:
                    yield _links(block.links)
                now, block, ids, sets = number, None, [], []
            if member:
                ids.append(doc)
                sets.append(tokens)
                continue
            if ids:
                block, ids, sets = Block(ids, sets), [], []
            if block:
                block.ask(None, doc, tokens)
        if ids:
            block = Block(ids, sets)
        if block:
            yield _links(block.links)

    return rows.mapInArrow(run, "a bigint, b bigint")


def _unpacked(batches, shingler: Shingler, unpack):
    """Rows with their sets; other texts of a document id than the class's are passed over."""
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            part = batch.slice(low, 64)
            numbers, members, docs, names, packed = (c.to_pylist() for c in part.columns)
            tokens, bounds = shingler.sets([unpack.decompress(p).decode() for p in packed])
            found = _sums(tokens, bounds)[0].tolist()
            for i, name in enumerate(names):
                if found[i] == name:
                    yield numbers[i], members[i], docs[i], tokens[bounds[i] : bounds[i + 1]]


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return batch_of(_LINK, [[a for a, _ in links], [b for _, b in links]])


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``packed``: texts compressed for their way through the shuffles."""
    schema = pa.schema([("doc_id", pa.int64()), ("packed", pa.binary())])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for rows, texts in text_slices(batches):
            yield batch_of(schema, [rows.column(0), [pack.compress(t.encode()) for t in texts]])

    return _texts(docs).where("doc_id IS NOT NULL").mapInArrow(run, "doc_id bigint, packed binary")


def links(docs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (``s1``, ``s2``, ``n``, ``rep``: the least document of each) and the links
    between their representatives that join them, ``a`` and ``b``."""
    named = sets.where("cell IS NULL AND doc_id IS NOT NULL AND n > 0")
    classes = written(named.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    live = written(live_tokens(written(prefixes(docs, _levels(sets)), "prefixes")), "live")
    block_of = written(blocks(live), "blocks")
    asked = candidates(live, block_of).join(classes.select("s1", F.col("rep").alias("doc_id")), "s1")
    shipped = _packed(docs).join(asked, "doc_id").select("block", "member", "doc_id", "s1", "packed")
    found = _verified(shipped.repartition("block").sortWithinPartitions("block", F.desc("member"), "doc_id"))
    return classes, found


def join(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``."""
    sets = written(shingle_sets(docs), "sets")
    classes, found = links(docs, sets)
    rows = sets.where("cell IS NULL")
    member = rows.join(classes, ["s1", "s2", "n"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    # documents with several texts join the classes of all of them
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    same = member.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    joined = components(found.union(same))
    return member.join(joined, F.col("rep") == F.col("node"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the least id of each component, one row of each of its texts. Rows
    without an id belong to no component; one row of each of their texts stays.

    Only rows of an id that comes more than once are held against each other by their texts.
    """
    (rows,) = fresh(docs, "_rows")
    least = join(docs.select("doc_id", "text")).where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias(rows))
    kept = docs.join(least, "doc_id")
    once = kept.where(F.col(rows) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    again = kept.where(F.col(rows) > 1).select(*[F.col(f"`{c}`") for c in docs.columns]).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"]))


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """The same by comparing all pairs of a small table: set size and component."""
    sets = {}
    for doc, text in texts.items():
        words = (text or "").encode().lower().split()
        many = [tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)]
        sets[doc] = set(many) if many else {tuple(words)} if words else set()
    root = {d: d for d in sets}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= SHARE * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}
