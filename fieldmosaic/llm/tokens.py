"""Token ids of whole texts by the tokenizers library, at the price of distinct words."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from fieldmosaic.llm.common import offsets_of, ragged

#: An ASCII letter and what never shares a pre-token with it.
_STOP = re.compile(rb"(?<=[a-z])([.,:;!?])")
#: Lower-case letters in their composed form: normalisation leaves them alone and they are
#: one pre-token, so that the library's merges can be asked directly.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: One encoder per tokenizer file and Python worker; workers serve many tasks.
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: printable
    Latin-1 bytes stand for themselves, the others follow from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(others)}


class _Index(dict):
    """Numbers words as they come and lists the new ones."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class RunTable:
    """Ids of distinct runs of text, and of texts put together from runs.

    ``limit`` bounds the runs that are kept; beyond it the table starts anew, which costs
    time only. Subclasses give ``look_up``.
    """

    def __init__(self, limit: int = 700_000):
        self.limit = limit
        self._clear()

    def look_up(self, runs: list) -> list[list[int]]:
        raise NotImplementedError

    def _clear(self) -> None:
        self.index = _Index()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)

    def _learn(self) -> None:
        runs, self.index.new = self.index.new, []
        if not runs:
            return
        ids = self.look_up(runs)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(lengths.sum()), len(self.index) - len(runs)
        if len(self.index) > len(self.starts):
            size = 2 * len(self.index)
            self.starts, self.lengths = np.resize(self.starts, size), np.resize(self.lengths, size)
        if self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + total))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.starts[n : n + len(runs)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(runs)] = lengths
        self.used += total

    def put_together(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, given as lists of runs, one behind the other; where each text's
        ids begin and end; each run's number in the table; where each text's runs do."""
        if len(self.index) > self.limit:
            self._clear()
        ends = offsets_of(np.fromiter(map(len, texts), np.int64, len(texts)))
        codes = np.fromiter(map(self.index.__getitem__, chain.from_iterable(texts)), np.int64, int(ends[-1]))
        self._learn()
        lengths = self.lengths[codes]
        return ragged(self.ids, self.starts[codes], lengths), offsets_of(lengths)[ends], codes, ends


class WordEncoder(RunTable):
    """Ids of whole texts for a byte-level tokenizer that drops white space and lowers letters.

    Nothing that such a tokenizer does reaches across ASCII white space: normalisation,
    pre-tokenization, special tokens and merges all stay inside a run of other characters.
    So each distinct run is encoded by the library once. To have fewer distinct runs, ASCII
    letters are lowered beforehand and a space goes between a letter and a stop; texts with
    the start of a special token are left as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()

    @staticmethod
    def _runs(text: bytes) -> list[bytes]:
        return text.split() if b"<|" in text else _STOP.sub(rb" \1", text.lower()).split()

    def look_up(self, runs: list[bytes]) -> list[list[int]]:
        merge, letters = self.tokenizer.model.tokenize, self.letters
        ids = []
        for w in runs:
            if w.isalpha() and w.islower():
                ids.append([t.id for t in merge(w.decode())])
            elif _PLAIN.fullmatch(w):
                ids.append([t.id for t in merge(w.decode("latin-1").translate(letters))])
            else:
                ids.append(None)
        rest = [i for i, x in enumerate(ids) if x is None]
        for low in range(0, len(rest), 4096):
            at = rest[low : low + 4096]
            for i, e in zip(at, self.tokenizer.encode_batch_fast([runs[i].decode() for i in at], add_special_tokens=False), strict=True):
                ids[i] = e.ids
        return ids

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` one behind the other, and each text's number of ids.
        ``end_id`` is put behind every text."""
        ids, bounds, _, _ = self.put_together([self._runs(t.encode()) for t in texts])
        counts = np.diff(bounds)
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            counts = counts + 1
        return ids, counts
