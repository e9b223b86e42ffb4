"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Shallow trees are boosted in cycles, one feature at a time, and add up to a
lookup table for each feature; then tables over pairs of features take up what is left. A score is a sum of table entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import fold, labelled

#: Labelled rows that are learned from, at most (about).
FIT_ROWS = 10_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
FEATURES = (
    "words", "word_length", "letters", "capitals", "digits", "symbols", "marks", "bars", "bangs", "lines", "line_words",
    "repeated_lines", "distinct_words", "repeated_pairs", "longest_word", "commonest_word", "links", "ends",
)

_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-ÞĀ-Ž]")
_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(0x80, 0x100))
_DROP = {
    "digits": b"0123456789", "symbols": b"#*$%&<>~^=+_\\{}[]@", "marks": b".,;:!?\"'()-", "bars": b"|", "bangs": b"!",
}


def features(text: str | None) -> tuple[float, ...]:
    """The values of FEATURES; all zero for a text without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    raw = text.encode()
    size = len(raw)
    share = {k: (size - len(raw.translate(None, drop))) / size for k, drop in _DROP.items()}
    counts = Counter(words)
    lines = [s for s in text.split("\n") if s.strip()]
    pairs = Counter(zip(words, words[1:]))
    letters = size - len(raw.translate(None, _LETTERS))
    upper = len(_CAPITALS.findall(text)) / len(text)
    return (
        float(np.log1p(n)), len("".join(words)) / n, letters / size, upper, share["digits"], share["symbols"], share["marks"], share["bars"], share["bangs"],
        float(np.log1p(len(lines))), n / len(lines), 1 - len(set(lines)) / len(lines), len(counts) / n,
        1 - len(pairs) / max(n - 1, 1), float(max(map(len, counts))), max(counts.values()) / n,
        (text.count("http") + text.count("www.")) / n, sum(w[-1] in ".!?" for w in words) / n,
    )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cut(values: np.ndarray, bins: int) -> np.ndarray:
    """Edges of bins of about equal counts."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


class Additive:
    """Tables over features (edges, table) and over pairs (i, j, edges, edges, table)."""

    def __init__(self, base: float, single: list, pairs: list):
        self.base, self.single, self.pairs = base, single, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features."""
        z = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(self.single):
            z += table[np.searchsorted(edges, x[:, k], "right")]
        for i, j, a, b, table in self.pairs:
            z += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return _sigmoid(z)


def _tree(gradient: np.ndarray, hessian: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A tree over ordered bins with up to 2 ** depth leaves, as a table of leaf values."""
    out = np.empty(len(gradient))
    todo = [(0, len(gradient), depth)]
    while todo:
        a, z, left = todo.pop()
        g, h = np.cumsum(gradient[a:z]), np.cumsum(hessian[a:z])
        gain = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge) - g[-1] ** 2 / (h[-1] + ridge)
        if left and len(gain) and gain.max() > 1e-9:
            cut = a + int(gain.argmax()) + 1
            todo += [(a, cut, left - 1), (cut, z, left - 1)]
        else:
            out[a:z] = -g[-1] / (h[-1] + ridge)
    return out


def fit_additive(x: np.ndarray, labels: np.ndarray, cycles: int = 150, rate: float = 0.1, depth: int = 2, ridge: float = 2.0) -> Additive:
    y = np.asarray(labels, float)
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Additive(base, [], [])
    edges = [_cut(x[:, k], BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(n, base)
    for _ in range(cycles):
        for k, own in enumerate(bins):
            p = _sigmoid(z)
            step = rate * _tree(np.bincount(own, p - y, len(tables[k])), np.bincount(own, p * (1 - p), len(tables[k])), depth, ridge)
            tables[k] += step
            z += step[own]
    coarse = [_cut(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wide = len(coarse[j]) + 1
        own, most = cells[i] * wide + cells[j], (len(coarse[i]) + 1) * wide
        p = _sigmoid(z)
        return own, np.bincount(own, p - y, most), np.bincount(own, p * (1 - p), most)

    gains = {}
    for i in range(x.shape[1]):
        for j in range(i):
            _, g, h = sums(i, j)
            gains[i, j] = float((g**2 / (h + 5 * ridge)).sum())
    chosen = sorted(gains, key=lambda ij: (-gains[ij], ij))[:PAIRS]
    pair_tables = {ij: np.zeros((len(coarse[ij[0]]) + 1) * (len(coarse[ij[1]]) + 1)) for ij in chosen}
    for _ in range(cycles // 3):
        for ij in chosen:
            own, g, h = sums(*ij)
            step = -rate * g / (h + 5 * ridge)
            pair_tables[ij] += step
            z += step[own]
    pairs = [(i, j, coarse[i], coarse[j], t.reshape(len(coarse[i]) + 1, -1)) for (i, j), t in pair_tables.items()]
    return Additive(base, list(zip(edges, tables, strict=True)), pairs)


def learn(documents: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, fit_rows: int = FIT_ROWS) -> Additive:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [list(features(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    rows = labelled(documents, labels, "quality", parts, held, fit_rows).mapInArrow(run, "x array<double>, label int").collect()
    rows.sort(key=lambda r: (r.x, r.label))  # the order of rows does not matter then
    return fit_additive(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.label for r in rows]))


def score(documents: DataFrame, model: Additive) -> DataFrame:
    """documents(doc_id, text) -> doc_id, score (0 to 1). Null, empty and blank texts get the score of all-zero features.

    Repeated rows and null ids are scored one by one; no rows give no rows; other columns are ignored. Texts are read whole.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x), pa.float64())], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labels outside the held-out fold."""
    scored = score(documents, learn(documents, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
