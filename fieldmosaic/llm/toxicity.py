"""Toxicity scores that see through disguised spelling.

A noisy channel: a disguised word is a true word sent through a channel that writes
letters as look-alikes, puts separators between them and repeats them. Suspicious runs of
a text (single characters with separators, letters mixed with look-alikes, a letter three
times or more) become a lattice: each character may stand for itself, for letters it looks
like, or for nothing. Viterbi decoding picks the path that is likeliest under the channel
and a character trigram model counted over the whole corpus. Signs at a run's ends may be
letters or punctuation and are read both ways. Characters that are not seen go, letters of
other scripts beside Latin ones are read as these, a separator between letters and a doubled
letter are read with and without; characters with separators between them are
also read as several words, as a lattice of them may end a word anywhere. Runs have no
length limit: time and memory follow their length. The restored words are scored beside
the text's own words.

What makes a word toxic is learned from labels: words, and word beginnings of four to seven
letters, that come in toxic documents far more than in others. Near copies of a document
count once: documents that agree in the least hash of their runs of three words are one
family. A feature is kept when
its likelihood ratio outweighs the number of features looked at. A document's score grows
with the precision of its strongest features.

A null or empty text has no words and the lowest score. Without labels, or with one class
only, no feature is learned and all scores are equal. Every row is scored on its own text,
so ties and repeated rows have no effect; extra columns pass through.
"""

from __future__ import annotations

import dataclasses
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmosaic.llm.common import batch_of, text_slices, whole_text
from fieldmosaic.llm.labelled import sample

#: The letters that a character may be read as.
LOOK_ALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou",
}
_SIGNS = re.escape("".join(LOOK_ALIKES))
_SINGLE = rf"(?:[^\W\d_]|[{_SIGNS}])"
#: Suspicious runs without white space: single characters with separators between them; a
#: look-alike beside a letter; a letter three times.
_SEPARATED = re.compile(rf"{_SINGLE}(?:[.\-_~/,*]{_SINGLE}){{2,}}")
_MIXED = re.compile(rf"[^\W\d_][{_SIGNS}]|[{_SIGNS}][^\W\d_]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_EDGE = ".,;:!?\"'()[]{}*$%&#|-_~/"
#: Punctuation that is no letter's look-alike.
_PLAIN_EDGE = "".join(c for c in _EDGE if c not in LOOK_ALIKES)
#: Letters of other scripts that look like Latin ones.
_FOREIGN = str.maketrans("авеікмнорстухѕјɡοαν", "abeikmhopctyxsjgoav")
#: Characters that are not seen.
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_LATIN = re.compile("[a-z]")
#: One separator between letters; the same letter twice.
_JOINED = re.compile(r"(?<=[^\W\d_])[.\-_~/,*](?=[^\W\d_])")
_DOUBLE = re.compile(r"([^\W\d_])\1")
WORD = re.compile(r"[^\W\d_]+")
#: Letters of the character model; number 0 is everything else, and the end of a word.
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
_A = len(ALPHABET) + 1
_TABLE = np.zeros(0x110000, np.uint8)
_TABLE[[ord(c) for c in ALPHABET]] = np.arange(1, _A)
#: Costs (negative logarithms) of what the channel does to a character.
SWAP, REPEAT, DROP, STRAY = 1.0, 0.5, 0.3, 12.0
#: Longest run whose reading is kept for the next time.
REMEMBERED = 60
LENGTHS = (4, 5, 6, 7)
#: Precision of a feature at least.
PRECISE = 0.75


def trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of letter triples over all documents, as an array of three letters. At most
    one row per triple of the alphabet reaches the driver."""
    schema = pa.schema([("triple", pa.int32()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(_A**3, np.int64)
        for _, texts in text_slices(batches):
            letters = np.frombuffer(" ".join(texts).lower().encode("utf-32-le"), np.uint32)
            c = np.concatenate([[0, 0], _TABLE[letters], [0, 0]]).astype(np.int32)
            total += np.bincount((c[:-2] * _A + c[1:-1]) * _A + c[2:], minlength=_A**3)
        at = np.flatnonzero(total)
        yield batch_of(schema, [at, total[at]])

    counted = docs.select(whole_text().alias("text")).mapInArrow(count, "triple int, n bigint")
    rows = counted.groupBy("triple").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_A**3, np.int64)
    out[rows["triple"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(_A, _A, _A)


def costs(counts: np.ndarray) -> np.ndarray:
    """Negative log-probabilities of a letter after two others, smoothed by the letter after
    one, and that by its own frequency."""
    counts = counts.astype(float).copy()
    counts[:, 0, 0] = 0  # what follows a word's end says nothing
    single = counts.sum((0, 1)) + 1.0
    single /= single.sum()
    double = counts.sum(0) + 5.0 * single
    double /= double.sum(1, keepdims=True)
    triple = counts + 5.0 * double
    return -np.log(triple / triple.sum(2, keepdims=True)).astype(np.float32)


def _spelled(path: tuple | None) -> str:
    """The letters of a linked path; number 0 is the end of a word."""
    letters = []
    while path:
        path, code = path
        letters.append(ALPHABET[code - 1] if code else " ")
    return "".join(reversed(letters))


def _cores(run: str) -> set[str]:
    """A run less the punctuation around it. Signs at its ends that look like letters may be
    either, so it is also cut wherever these change."""
    run = run.strip(_PLAIN_EDGE)
    inner = len(run.lstrip(_EDGE))
    if not inner:
        return set()
    first, last = len(run) - inner, len(run.rstrip(_EDGE))
    starts = {0, first, *[i for i in range(1, first) if run[i] != run[i - 1]]}
    ends = {len(run), last, *[i for i in range(last + 1, len(run)) if run[i] != run[i - 1]]}
    return {run[i:j].strip(_PLAIN_EDGE) for i in starts for j in ends}


def _seen(run: str) -> str:
    """A run as it looks: without what is not seen, and with letters of other scripts between
    Latin ones as the Latin ones they look like."""
    if run.isascii():
        return run
    run = _UNSEEN.sub("", run)
    return run.translate(_FOREIGN) if _LATIN.search(run) else run


@lru_cache(maxsize=100_000)
def _single(run: str) -> str:
    """The one character that a run of at most three is without what surrounds it, or nothing."""
    shown = run if len(run) == 1 else _seen(run).rstrip(_PLAIN_EDGE)
    return shown if len(shown) == 1 else ""


def _family(text: str) -> int:
    """What near copies mostly share: the least hash of their runs of three words. Documents
    that are no near copies have few such runs in common and hardly ever the least one."""
    runs = text.lower().split()
    return min(xxhash.xxh3_64_intdigest(" ".join(runs[i : i + 3])) for i in range(max(1, len(runs) - 2))) >> 1


class Decoder:
    """Viterbi over character lattices; a state is the last two letters of the path."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost
        self._short = lru_cache(maxsize=200_000)(self._decode)

    def decode(self, run: str, spaced: bool, cut: bool = False) -> str:
        """The same as ``_decode``; only what takes little memory is remembered."""
        return (self._short if len(run) <= REMEMBERED else self._decode)(run, spaced, cut)

    def _readings(self, run: str, spaced: bool) -> list[list[tuple[int, float]]]:
        out = []
        for i, c in enumerate(run):
            options = []
            if c in _CODE:
                options.append((_CODE[c], 0.0))
            options += [(_CODE[x], SWAP) for x in LOOK_ALIKES.get(c, "")]
            if i and c == run[i - 1]:
                options.append((0, REPEAT))
            elif c not in _CODE:
                options.append((0, DROP if spaced and c not in LOOK_ALIKES else STRAY))
            out.append(options)
        return out

    def _decode(self, run: str, spaced: bool, cut: bool = False) -> str:
        """The likeliest reading; with ``cut``, words with blanks between them. A path is
        its last letter and the path before, so that paths share what they have in common."""
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        cost = self.cost
        for options in self._readings(run, spaced):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (spent, path) in paths.items():
                for code, extra in options:
                    state = (b, code) if code else (a, b)
                    total = spent + extra + (float(cost[a, b, code]) if code else 0.0)
                    if state not in new or total < new[state][0]:
                        new[state] = (total, (path, code) if code else path)
            if cut:
                ends = [(spent + float(cost[a, b, 0]), path) for (a, b), (spent, path) in new.items() if b]
                if ends:
                    total, path = min(ends, key=lambda e: e[0])
                    if (0, 0) not in new or total < new[0, 0][0]:
                        new[0, 0] = (total, (path, 0))
            paths = new
        ends = [(spent + (float(cost[a, b, 0]) if b or not cut else 0.0), path) for (a, b), (spent, path) in paths.items()]
        least = min(spent for spent, _ in ends)
        return min(_spelled(path) for spent, path in ends if spent == least)

    def _spaced(self, run: str) -> list[str]:
        """A row of separated characters as one word and as several: cut where that is
        likeliest, and what may begin a word at any other place."""
        word = self.decode(run, True)
        begun = [word[i : i + LENGTHS[-1]] for i in range(1, len(word) - LENGTHS[0] + 1)]
        return [word, *self.decode(run, True, True).split(), *begun]

    def in_run(self, run: str) -> list[str]:
        """The words of a lower-case run without white space, and those it may stand for."""
        core = run.strip(_PLAIN_EDGE)
        if core.isascii() and core.isalpha():  # most runs: a word with punctuation around it
            found = [core]
            if len(core) >= 3 and _DOUBLE.search(core):
                if _TRIPLE.search(core):
                    found.append(self.decode(core, False))
                found.append(_DOUBLE.sub(r"\1", core))
            return found
        found = WORD.findall(run)
        run = _seen(run)
        for core in _cores(run):
            if len(core) >= 3:
                if _SEPARATED.fullmatch(core):
                    found += self._spaced(core)
                    continue
                whole = _JOINED.sub("", core)
                if whole != core or run not in found:
                    found += WORD.findall(whole)
                found += [self.decode(c, False) for c in {core, whole} if _TRIPLE.search(c) or _MIXED.search(c)]
                if _DOUBLE.search(whole):
                    found += WORD.findall(_DOUBLE.sub(r"\1", whole))
        return found

    def in_singles(self, runs: list[str]) -> list[str]:
        """Words written as three or more single characters. Such a row is also read
        without its first or last character, which may be a word of its own, and as
        several words."""
        at = [i for i, r in enumerate(runs) if len(r) <= 3 and _single(r)]
        found, low = [], 0
        while low < len(at):
            high = low + 1
            while high < len(at) and at[high] == at[high - 1] + 1:
                high += 1
            if high - low >= 3:
                word, *several = self._spaced("".join(map(_single, runs[at[low] : at[high - 1] + 1])))
                found += [word, word[1:], word[:-1], *several]
            low = high
        return found


def word_features(word: str) -> list[str]:
    """The word, and its beginnings; words of fewer than three letters have none."""
    if len(word) < 3:
        return []
    return ["=" + word, *["^" + word[:n] for n in LENGTHS if len(word) >= n]]


def words_of(text: str, decoder: Decoder) -> set[str]:
    runs = text.lower().split()
    found = {w for r in set(runs) for w in decoder.in_run(r)}
    return found.union(decoder.in_singles(runs)) - {""}


@dataclasses.dataclass(frozen=True)
class Model:
    """Precision of each feature that speaks for toxicity, and the score without any."""

    cost: np.ndarray
    precision: dict[str, float]
    least: float


def _feature_rows(found: DataFrame, cost: np.ndarray, wanted: frozenset[str] | None) -> DataFrame:
    """``feature``, ``family``: once per family and task. ``wanted`` limits the features."""
    schema = pa.schema([("feature", pa.string()), ("family", pa.int64())])

    def run(batches):
        decoder = Decoder(cost)
        for _, texts in text_slices(batches):
            pairs = set()
            for text in texts:
                words, family = words_of(text, decoder), _family(text)
                for w in words:
                    pairs.update((f, family) for f in word_features(w) if wanted is None or f in wanted)
            yield batch_of(schema, [[f for f, _ in pairs], [n for _, n in pairs]])

    return found.select("doc_id", "text").mapInArrow(run, "feature string, family bigint").distinct()


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", toxic_rows: int = 5_000, clean_rows: int = 15_000,
    least_families: int = 3, features: int = 200_000,
) -> Model:
    """The character model from all of ``docs``, and features from at most about
    ``toxic_rows`` and ``clean_rows`` labelled documents whose ids are ``usable``.

    Features of toxic documents are counted first and the ``features`` most frequent are
    looked up in the clean ones, so that both steps hold a bounded number of them.
    """
    cost = costs(trigrams(docs))
    toxic = sample(docs, labels.where(F.col(label) == 1), label, usable, toxic_rows)
    clean = sample(docs, labels.where(F.col(label) == 0), label, usable, clean_rows)

    def counts(rows: DataFrame) -> DataFrame:
        return rows.groupBy("feature").agg(F.count("*").alias("n"))

    def size(found: DataFrame) -> int:
        return found.select("doc_id").distinct().count()

    n_toxic, n_clean = size(toxic), size(clean)
    share = (n_toxic + 1) / (n_toxic + n_clean + 2)
    first = counts(_feature_rows(toxic, cost, None)).where(F.col("n") >= least_families)
    a = {r["feature"]: r["n"] for r in first.orderBy(F.desc("n"), "feature").limit(features).collect()}
    b = {r["feature"]: r["n"] for r in counts(_feature_rows(clean, cost, frozenset(a))).collect()} if a and n_clean else {}
    precision = {}
    for f, n in a.items() if n_clean else ():
        other = b.get(f, 0)
        p = n / (n + other)
        ratio = n * math.log(p / share) + (other * math.log((1 - p) / (1 - share)) if other else 0.0)
        smooth = (n + share) / (n + other + 1)
        if p > share and ratio > math.log(len(a)) + 2 and smooth >= PRECISE:
            precision[f] = smooth
    return Model(cost, precision, share / 4)


class Scorer:
    #: Distinct runs that are kept.
    LIMIT = 500_000

    def __init__(self, model: Model):
        self.model, self.decoder = model, Decoder(model.cost)
        #: Whole words and word beginnings that are features, and the first letters of the latter.
        self.whole = {f[1:]: p for f, p in model.precision.items() if f[0] == "="}
        self.begun = {f[1:]: p for f, p in model.precision.items() if f[0] == "^"}
        self.starts = {f[: LENGTHS[0]] for f in self.begun}
        #: Runs that mean nothing, and the strongest word of others.
        self.plain: set[str] = set()
        self.runs: dict[str, tuple[float, str]] = {}

    def _strongest(self, words: list[str]) -> tuple[float, str]:
        """The greatest precision of a feature (see ``word_features``) of the words, and the word."""
        best = (0.0, "")
        for w in words:
            if len(w) >= 3:
                p = self.whole.get(w, 0.0)
                if w[: LENGTHS[0]] in self.starts:
                    p = max(p, *(self.begun.get(w[:n], 0.0) for n in LENGTHS if len(w) >= n))
                if p and (p, w) > best:
                    best = (p, w)
        return best

    def _of_run(self, run: str) -> tuple[float, str]:
        found = self.runs.get(run)
        if found is None:
            if len(self.runs) + len(self.plain) > self.LIMIT:
                self.runs.clear()
                self.plain.clear()
            found = self._strongest(self.decoder.in_run(run))
            if found[0]:
                self.runs[run] = found
            else:
                self.plain.add(run)
        return found

    def score(self, text: str) -> float:
        """One less the chance that none of the three strongest words means it."""
        runs = text.lower().split()
        strong = {w: p for p, w in map(self._of_run, set(runs).difference(self.plain)) if p}
        p, w = self._strongest(self.decoder.in_singles(runs))
        if p:
            strong[w] = p
        clean = 1 - self.model.least
        for p in sorted(strong.values(), reverse=True)[:3]:
            clean *= 1 - p
        return 1 - clean


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) in the last column; a column of that name is replaced.
    Documents don't move between tasks."""
    kept = docs.select(*[c for c in docs.columns if c != "score"])
    names = kept.columns

    def run(batches):
        scorer = Scorer(model)
        for part, texts in text_slices(batches, text):
            scores = pa.array([scorer.score(t or "") for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*names, "score"])

    schema = kept.withColumn("score", F.lit(0.0)).schema
    return kept.mapInArrow(run, schema)
