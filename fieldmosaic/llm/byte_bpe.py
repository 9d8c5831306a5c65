"""Byte-level BPE by DuckDB: recursive queries encode, ordered aggregation decodes.

Each task cuts its texts into pre-tokens by the pattern and has a DuckDB connection of its
own worker, in memory and with one thread, encode the distinct ones in blocks. A word is
rows of (word, position, token), its bytes at first. Each step of the recursion joins
neighbouring tokens with the merge table and contracts every word's leftmost pair of least
rank: the pair's place takes the merged token and the next place is left out. Words without
a pair leave the recursion; the rows of a word's last step are its tokens. A word that is a token itself is that token, as the
library has it. Decoding joins ids with the tokens' bytes and strings them together in
order.

One step contracts one pair of a word, so a word of n bytes takes up to n steps of up to n
rows, which that recursion keeps. Words over ``LONG`` bytes take a second recursive query, which keeps
a row per place under its key and not one per step. A step of it contracts all pairs of a
word's least rank, every other one of a chain of overlapping ones, where no merge with the new token
has a lesser rank, and the leftmost alone where one has; both are what single steps come to.
Words over ``LONGEST`` bytes, which no language has, are contracted by a heap of pairs in
the same order, for their steps times places would be too many.

A null text is an empty one and has no ids. Every row stands for itself, so ties and
repeated rows have no effect; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmosaic.llm.common import batch_of, int_lists, text_slices, whole_text
from fieldmosaic.llm.tokens import RunTable

#: Bytes up to which a word takes the first query, and up to which the second.
LONG = 100
LONGEST = 1_000
#: Bytes of words that one recursive query encodes.
BLOCK = 150_000

ENCODE = """
WITH RECURSIVE token(word, place, id, step) AS (
  SELECT word, place, id, 0 FROM bytes
  UNION ALL
  (WITH pair AS (
     SELECT word, place, id, lead(id) OVER w AS right_id, lead(place) OVER w AS right_place FROM token
     WINDOW w AS (PARTITION BY word ORDER BY place)),
   least AS (
     SELECT p.word, min((m.rank << 32) | p.place) AS best, arg_min(p.right_place, (m.rank << 32) | p.place) AS right_place
     FROM pair p JOIN merge m ON m.left_id = p.id AND m.right_id = p.right_id GROUP BY p.word)
   SELECT t.word, t.place, CASE WHEN t.place = (best & 4294967295) THEN (best >> 32)::INTEGER ELSE t.id END, t.step + 1
   FROM token t JOIN least USING (word) WHERE t.place <> least.right_place)),
last AS (SELECT word, max(step) AS step FROM token GROUP BY word)
SELECT word, list(id ORDER BY place) AS ids FROM token JOIN last USING (word, step) GROUP BY word
"""
ENCODE_LONG = """
WITH RECURSIVE token(word, place, id) USING KEY (word, place) AS (
  SELECT word, place, id FROM bytes
  UNION
  (WITH pair AS (
     SELECT word, place, id, lead(id) OVER w AS right_id, lead(place) OVER w AS right_place
     FROM recurring.token WHERE id >= 0 WINDOW w AS (PARTITION BY word ORDER BY place)),
   ranked AS (
     SELECT p.word, p.place, p.right_place, m.rank, m.alone FROM pair p JOIN merge m ON m.left_id = p.id AND m.right_id = p.right_id),
   least AS (
     SELECT r.*, lag(right_place) OVER w IS NOT DISTINCT FROM place AS chained, row_number() OVER w AS nth
     FROM ranked r JOIN (SELECT word, min(rank) AS rank FROM ranked GROUP BY word) USING (word, rank)
     WINDOW w AS (PARTITION BY word ORDER BY place)),
   chain AS (SELECT *, max(CASE WHEN chained THEN 0 ELSE nth END) OVER (PARTITION BY word ORDER BY place) AS head FROM least),
   chosen AS (SELECT * FROM chain WHERE nth = 1 OR (NOT alone AND (nth - head) % 2 = 0))
   SELECT word, place, rank::INTEGER FROM chosen UNION ALL SELECT word, right_place, -1 FROM chosen))
SELECT word, list(id ORDER BY place) AS ids FROM token WHERE id >= 0 GROUP BY word
"""
DECODE = """
SELECT word, string_agg(t.bytes, '' ORDER BY place) AS bytes
FROM (SELECT word, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM encoded) e JOIN token_bytes t USING (id)
GROUP BY word
"""


class BpeTable(RunTable):
    """Ids and decoded bytes of pre-tokens, through a DuckDB connection."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        self.decoded: list[bytes] = []
        super().__init__(limit=1_000_000)
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        pairs = [
            (self.ranks[t[:i]], self.ranks[t[i:]], rank)
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        merge = pa.table(dict(zip(("left_id", "right_id", "rank"), np.array(pairs, np.int64).T, strict=True)))
        named = pa.table({"id": list(self.ranks.values()), "bytes": [t.hex() for t in self.ranks]})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        self.db.register("merge_rows", merge)
        self.db.register("token_rows", named)
        # alone: a merge with this one's token has a lesser rank and would come next
        self.db.execute(
            "CREATE TABLE merge AS SELECT left_id::INTEGER AS left_id, right_id::INTEGER AS right_id, rank, "
            "EXISTS (SELECT 1 FROM merge_rows o WHERE o.left_id = m.rank AND o.rank < m.rank) "
            "OR EXISTS (SELECT 1 FROM merge_rows o WHERE o.right_id = m.rank AND o.rank < m.rank) AS alone FROM merge_rows m"
        )
        self.db.execute("CREATE TABLE token_bytes AS SELECT id::INTEGER AS id, bytes FROM token_rows")

    def _clear(self) -> None:
        super()._clear()
        self.decoded.clear()

    def _contract(self, word: bytes) -> list[int]:
        """Least rank first, leftmost of equals, by a heap; for the longest words."""
        tokens = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < len(tokens):
                rank = self.ranks.get(tokens[i] + tokens[after[i]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, tokens[i], tokens[after[i]]))

        for i in range(len(tokens)):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != left or j >= len(tokens) or tokens[j] != right:
                continue
            tokens[i], tokens[j], after[i] = left + right, b"", after[j]
            if after[i] < len(tokens):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.ranks[t] for t in tokens if t]

    def look_up(self, runs: list[str]) -> list[list[int]]:
        words = [w.encode() for w in runs]
        ids = [None if (rank := self.ranks.get(w)) is None else [rank] for w in words]
        for i, w in enumerate(words):
            if ids[i] is None and len(w) > LONGEST:
                ids[i] = self._contract(w)
        rest = [i for i, x in enumerate(ids) if x is None]
        self._query(ENCODE, words, [i for i in rest if len(words[i]) <= LONG], ids)
        self._query(ENCODE_LONG, words, [i for i in rest if len(words[i]) > LONG], ids)
        self._decode(ids)
        return ids

    def _query(self, sql: str, words: list[bytes], rest: list[int], ids: list) -> None:
        """The ids of some of the words, by a recursive query for each block of them."""
        ends = np.cumsum([len(words[i]) for i in rest])
        low = 0
        while low < len(rest):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK, side="right")))
            part = [words[i] for i in rest[low:high]]
            sizes = [len(w) for w in part]
            letters = np.frombuffer(b"".join(part), np.uint8)
            of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
            rows = {
                "word": np.repeat(np.array(rest[low:high], np.int32), sizes),
                "place": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]),
                "id": of_byte[letters],
            }
            self.db.register("bytes", pa.table(rows))
            for i, found in self.db.sql(sql).fetchall():
                ids[i] = found
            self.db.unregister("bytes")
            low = high

    def _decode(self, ids: list[list[int]]) -> None:
        low = len(self.decoded)
        self.decoded.extend([b""] * len(ids))
        for at in range(0, len(ids), 20_000):
            part = ids[at : at + 20_000]
            self.db.register("encoded", pa.table({"word": np.arange(at, at + len(part)), "ids": pa.array(part, pa.list_(pa.int32()))}))
            for i, letters in self.db.sql(DECODE).fetchall():
                self.decoded[low + i] = bytes.fromhex(letters)
            self.db.unregister("encoded")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """All ids, each text's number of ids, and the texts decoded from their ids."""
        ids, bounds, codes, ends = self.put_together([self.pattern.findall(t) for t in texts])
        runs = codes.tolist()
        back = [b"".join(map(self.decoded.__getitem__, runs[a:b])) for a, b in zip(ends, ends[1:], strict=False)]
        return ids, np.diff(bounds), back


@cache
def table(ranks_path: str, pattern: str) -> BpeTable:
    """One table per worker, which serves many tasks."""
    return BpeTable(ranks_path, pattern)


_ROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``, the bytes that the ids stand for."""

    def run(batches):
        for rows, texts in text_slices(batches):
            ids, counts, back = table(ranks_path, pattern).encode(texts)
            yield batch_of(_ROW, [rows.column(0), int_lists(ids, counts), back])

    return _texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encode`` with hashes in place of ids and bytes, taken in the same task."""

    def run(batches):
        for rows, texts in text_slices(batches):
            ids, counts, back = table(ranks_path, pattern).encode(texts)
            ends = np.cumsum(counts)
            raw = ids.astype("<u4")
            yield batch_of(
                _DIGEST,
                [
                    rows.column(0),
                    counts,
                    [hashlib.sha256(raw[e - n : e]).hexdigest() for e, n in zip(ends, counts, strict=True)],
                    [hashlib.sha256(b).hexdigest() for b in back],
                ],
            )

    return _texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
