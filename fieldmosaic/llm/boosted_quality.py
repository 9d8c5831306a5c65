"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each document becomes a row of ``FEATURES``, worked out from its whole text with numpy in
its task. The trees are fitted on a bounded sample of labelled documents (``rows``): the
statistics are cut into at most ``bins`` bins, each level of a tree sums gradients into
histograms per node, feature and bin, and takes the best cut per node. Trees are perfect
and lie in flat arrays, so a task scores all its rows by ``depth`` steps of array indexing.

A null text is an empty one and has a score like every other. Without labels, or with one
class only, every score is the smoothed share of the class. Every row is scored on its own
text, so ties and repeated rows have no effect; extra columns are left out.
"""

from __future__ import annotations

import dataclasses
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmosaic.llm.common import batch_of, offsets_of, text_slices, whole_text
from fieldmosaic.llm.labelled import sample

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "blank": b" \t\x0b\x0c\r", "line_end": b"\n", "stop": b".,;:", "exclaim": b"!?", "symbol": b"#*$%&|<>~^=+\\", "mark": b"'\"()[]{}-_/@`",
}
_NAMES = [*_CLASSES, "control", "beyond_ascii"]
FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", *_NAMES, "distinct_words", "distinct_triples", "same_as_before",
    "most_common_word", "one_letter_words", "capital_words", "upper_words", "log_lines", "words_per_line", "repeated_lines",
)
_TABLE = np.full(256, len(_NAMES) - 1, np.uint8)
_TABLE[:128] = len(_NAMES) - 2
for _i, _letters in enumerate(_CLASSES.values()):
    _TABLE[list(_letters)] = _i
_UPPER = re.compile(rb"[A-Z]{2}")


def _of_words(words: list[bytes]) -> list[float]:
    n = len(words)
    if not n:
        return [0.0] * 9
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, n)
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 2 else 1.0
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    capital = sum(map(bytes.istitle, words)) / n
    upper = sum(1 for w in words if _UPPER.match(w)) / n
    return [
        float(sizes.mean()), float(sizes.max()), len(counts) / n, triples, same, max(counts.values()) / n,
        float((sizes == 1).mean()), capital, upper,
    ]


def features(texts: list[str]) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    raw = [t.encode() for t in texts]
    ends = offsets_of(np.fromiter(map(len, raw), np.int64, len(raw)))
    kinds = _TABLE[np.frombuffer(b"".join(raw), np.uint8)]
    out = np.zeros((len(raw), len(FEATURES)))
    for i, text in enumerate(raw):
        size = max(len(text), 1)
        classes = np.bincount(kinds[ends[i] : ends[i + 1]], minlength=len(_NAMES)) / size
        words = text.split()
        lines = [line for line in text.split(b"\n") if line.strip()]
        length, longest, distinct, triples, same, common, single, capital, upper = _of_words(words)
        out[i] = [
            np.log1p(len(text)), np.log1p(len(words)), length, longest, *classes, distinct, triples, same, common, single,
            capital, upper, np.log1p(len(lines)), len(words) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        ]
    return out


@dataclasses.dataclass(frozen=True)
class Trees:
    """Perfect trees in flat arrays: node ``i`` sends values above its limit to ``2 i + 2``
    and the others to ``2 i + 1``."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        at = np.arange(len(rows))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                node = 2 * node + 1 + (rows[at, feature[node]] > limit[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(
    rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, penalty: float = 1.0,
    least: float = 1.0,
) -> Trees:
    """Logistic loss, second-order gains. ``least``: weight (hessian) of a child at least."""
    nodes = 2**depth - 1
    share = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(share / (1 - share)))
    empty = Trees(base, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    if not len(labels) or labels.min() == labels.max():
        return empty
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)])
    margin = np.full(len(labels), base)
    kept = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - labels, p * (1 - p)
        feature, limit = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        node = np.zeros(len(labels), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            chosen = np.full((2, width), -1)
            for f, codes in enumerate(binned):
                key = (node - first) * bins + codes
                g = np.bincount(key, grad, width * bins).reshape(width, bins).cumsum(1)
                h = np.bincount(key, hess, width * bins).reshape(width, bins).cumsum(1)
                gr, hr = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + penalty) + gr**2 / (hr + penalty) - g[:, -1:] ** 2 / (h[:, -1:] + penalty)
                gain[(h < least) | (hr < least)] = 0
                gain[:, len(cuts[f]) :] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                chosen[0, better] = f
                chosen[1, better] = top[better]
            for n in range(width):
                f, cut = chosen[:, n]
                if f >= 0:
                    feature[first + n], limit[first + n] = f, cuts[f][cut]
            node = 2 * node + 1 + (rows[np.arange(len(node)), feature[node]] > limit[node])
        g = np.bincount(node - nodes, grad, nodes + 1)
        h = np.bincount(node - nodes, hess, nodes + 1)
        leaf = -rate * g / (h + penalty)
        margin += leaf[node - nodes]
        for part, value in zip(kept, (feature, limit, leaf), strict=True):
            part.append(value)
    return Trees(base, *map(np.array, kept))


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", rows: int = 20_000, **settings) -> Trees:
    """Trees from at most about ``rows`` labelled documents whose ids are ``usable``. Their
    statistics, not their texts, come to the driver."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("row", pa.list_(pa.float64()))])

    def rows_of(batches):
        for part, texts in text_slices(batches):
            yield batch_of(schema, [part.column(0), part.column(2), list(features(texts))])

    found = sample(docs, labels, label, usable, rows).select("doc_id", "text", "label")
    got = found.mapInArrow(rows_of, "doc_id bigint, label int, row array<double>").toArrow().sort_by("doc_id")
    table = np.array(got["row"].to_pylist()).reshape(-1, len(FEATURES))
    return fit(table, got["label"].to_numpy().astype(float), **settings)


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for part, texts in text_slices(batches):
            yield batch_of(schema, [part.column(0), trees.score(features(texts))])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, score double")
