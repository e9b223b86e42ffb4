"""Toxicity by a factorization machine over hashed terms.

Terms are words and word beginnings, hashed into slots. Besides a weight for each slot the machine has a short factor vector,
and two terms of one text add the product of their vectors: an insult weighs more beside some words than alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 18
PREFIX = 5
FACTORS = 4
#: Labelled rows that are learned from, at most (about); and terms of the model.
FIT_ROWS, TERMS = 10_000, 1024
KEEP_WORDS = 200_000
TEXTS = 500

_word = re.compile(r"[^\W\d_]+")


class _Slots(dict):
    """word -> slots of the word and of its beginning."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > KEEP_WORDS:
            self.clear()
        terms = [word] + ([word[:PREFIX] + "*"] if len(word) > PREFIX else [])
        self[word] = value = tuple(xxhash.xxh3_64_intdigest(t) % SLOTS for t in terms)
        return value


_slots = _Slots()


def terms(text: str | None) -> np.ndarray:
    """The distinct slots of a text, sorted."""
    return np.array(sorted({s for w in set(_word.findall((text or "").lower())) for s in _slots[w]}), np.int32)


def _each(batches: Iterator[pa.RecordBatch], at: int, value) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches with the value of each text's terms. Some texts are decoded at a time, and no words stay known when a task ends."""
    for batch in batches:
        yield batch, [value(terms(t)) for k in range(0, batch.num_rows, TEXTS) for t in batch.column(at).slice(k, TEXTS).to_pylist()]
    _slots.clear()


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Machine:
    """Bias, weights and factors over the chosen slots."""

    def __init__(self, slots: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.slots, self.bias, self.weights, self.factors = slots, bias, weights, factors
        self.place = np.full(SLOTS, -1, np.int32)
        self.place[slots] = np.arange(len(slots))

    def __reduce__(self):
        return Machine, (self.slots, self.bias, self.weights, self.factors)

    def score(self, own: np.ndarray) -> float:
        at = self.place[own]
        at = at[at >= 0]
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()) if len(at) else 0.0
        return float(_sigmoid(np.float64(self.bias + self.weights[at].sum() + pairs)))


def fit_machine(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 60, rate: float = 0.05, seed: int = 7) -> Machine:
    """Fits on the slots of texts and their 0/1 labels, by AdaGrad on the logistic loss.

    The terms of the model are those whose presence departs most from the labels' shares (chi-square with a correction for
    small counts); ties go to the smaller slot.
    """
    y = np.asarray(labels, np.float32)
    n, p = len(y), float(y.mean()) if len(y) else 0.0
    if not n or p in (0.0, 1.0):
        return Machine(np.zeros(0, np.int64), float(np.log((p * n + 0.5) / ((1 - p) * n + 0.5))) if n else 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    flat, row = np.concatenate(texts), np.repeat(np.arange(n), [len(t) for t in texts])
    present, toxic = np.bincount(flat, minlength=SLOTS), np.bincount(flat, y[row], minlength=SLOTS)
    off = np.maximum(np.abs(toxic - p * present) - 0.5, 0) ** 2 / np.maximum(present * p * (1 - p), 1e-9)
    off[(present < 3) | (present == n)] = 0
    slots = np.sort(np.lexsort((np.arange(SLOTS), -off))[:TERMS])
    slots = slots[off[slots] > 3.84]
    place = np.full(SLOTS, -1)
    place[slots] = np.arange(len(slots))
    x = np.zeros((n, len(slots)), np.uint8)
    at = place[flat]
    x[row[at >= 0], at[at >= 0]] = 1
    random = np.random.default_rng(seed)
    weight = np.float32(np.sqrt((1 - p) / p))  # the rarer label counts more
    k = len(slots)
    bias, w, v = np.float32(np.log(p / (1 - p))), np.zeros(k, np.float32), random.normal(0, 0.01, (k, FACTORS)).astype(np.float32)
    gb, gw, gv = 1e-6, np.full(k, 1e-6, np.float32), np.full((k, FACTORS), 1e-6, np.float32)
    for _ in range(epochs):
        order = random.permutation(n)
        for a in range(0, n, 128):
            xb, yb = x[order[a : a + 128]].astype(np.float32), y[order[a : a + 128]]
            s = xb @ v
            z = bias + xb @ w + 0.5 * ((s**2).sum(axis=1) - (xb @ (v**2)).sum(axis=1))
            e = (_sigmoid(z) - yb) * np.where(yb == 1, weight, np.float32(1)) / len(yb)
            db, dw = e.sum(), xb.T @ e + 1e-5 * w
            dv = xb.T @ (e[:, None] * s) - (xb.T @ e)[:, None] * v + 1e-4 * v
            gb, gw, gv = gb + db**2, gw + dw**2, gv + dv**2
            bias, w, v = bias - rate * 4 * db / np.sqrt(gb), w - rate * 4 * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv)
    return Machine(slots, float(bias), w.astype(np.float64), v.astype(np.float64))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def sample_rows(rows: DataFrame, most: int) -> DataFrame:
    """About `most` rows at most, chosen by a hash of doc_id."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))


def labelled(documents: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int) -> DataFrame:
    """text and label of the documents to learn from: labelled, not of the held-out fold, a bounded sample.

    The sampled labels are at most about `most` rows of two numbers, so they are sent to the documents. A document with more
    than one label counts with each.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), parts) != held)).select("doc_id", F.col(label).cast("int").alias("_label"))
    return documents.select("doc_id", "text").join(F.broadcast(sample_rows(rows, most)), "doc_id").select("text", "_label")


def learn(documents: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, fit_rows: int = FIT_ROWS) -> Machine:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in _each(batches, 0, np.ndarray.tobytes):
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column(1)], ["terms", "label"])

    rows = labelled(documents, labels, "toxic", parts, held, fit_rows).mapInArrow(run, "terms binary, label int").collect()
    rows.sort(key=lambda r: (bytes(r.terms), r.label))  # the order of rows does not matter then
    return fit_machine([np.frombuffer(r.terms, np.int32) for r in rows], np.array([r.label for r in rows]))


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """documents(doc_id, text) -> doc_id, score (0 to 1). Null and empty texts get the score of a text without terms.

    Repeated rows and null ids are scored one by one; no rows give no rows; other columns are ignored. Texts are read whole.
    """
    shared = documents.sparkSession.sparkContext.broadcast(machine)  # at most TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _each(batches, 1, shared.value.score):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(documents: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of documents whose texts score below the threshold, with all their columns, whatever their names.

    Null and empty texts have the score of a text without terms, that of the labels' share; rows that stand twice have one score and stay or
    go alike; null ids are documents like others; no rows give no rows. Texts are read whole.
    """
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _each(batches, at, shared.value.score):
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labels outside the held-out fold."""
    scored = score(documents, learn(documents, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
