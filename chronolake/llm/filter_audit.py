"""Filter interaction audit: what each filter removes in every order of the filters.

A document is a mask of the filters that it fails, and a part of the corpus is a table of at most 2^filters cells: how many documents
have each mask. Everything about an order follows from the cells. The orders are visited by exchanging two neighbours at a time, so that
only the two steps of the exchange change; the Shapley sums gather what a filter removes for as long as it stays the same.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, stored

FILTERS = "ABCDE"
#: Parts whose walks are taken together: a batch of rows has at most this many times orders times steps.
PARTS = 32

_symbols = re.compile(rb"[#$%&*|]")
_capitals, _inside = UPPER.encode(), bytes(range(0x80, 0xC0))


def fails(text: bytes) -> int:
    """The mask of filters A to D that a text fails, A the lowest bit."""
    words = text.split()  # of bytes: only ASCII white space cuts
    n_chars = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, _inside)))
    capitals = len(text) - len(text.translate(None, _capitals))
    found = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * n_chars, _symbols.search(text) is not None)
    return sum(bad << k for k, bad in enumerate(found))


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(2)]
        digests = [hashlib.sha256(t).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(map(fails, texts), pa.int32())], ["doc_id", "part", "digest", "mask"])


def masks(documents: DataFrame) -> DataFrame:
    """doc_id, part and mask of each row of documents(doc_id, text, source); E is failed by a copy of the text of a smaller doc_id.

    The least id of each text is joined by id and text, a key that hardly repeats, so a text with very many copies is no large group.
    """
    own = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    own = stored(own.select("doc_id", "part", "text").mapInArrow(_masks, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, part string, digest binary, mask int"), "masks")
    firsts = own.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return own.join(firsts, ["doc_id", "digest"], "left").select("doc_id", "part", F.when(copy, F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E")))).otherwise(F.col("mask")).alias("mask"))


def neighbour_swaps(n: int) -> Iterator[int]:
    """The places k at which to exchange k and k + 1, one after the other, to visit every order of n things once."""
    if n < 2:
        return
    inner, down = neighbour_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        k = next(inner, None)
        if k is None:
            return
        yield k + 1 if down else k  # the last thing stands in front now, the others one place further on
        down = not down


def walk(cells: np.ndarray, n: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """The orders and, for each measure, an array [order, step, part]; cells is [part, mask, (all, good, toxic)].

    shapley is by order and step as well: that of the step's filter, the same in every order.
    """
    full, parts = (1 << n) - 1, len(cells)
    inside = cells.transpose(2, 1, 0).copy()  # of the masks that a set holds, by adding one filter after the other
    for f in range(n):
        has = (np.arange(1 << n) >> f) & 1 == 1
        inside[:, has] += inside[:, ~has]
    left = inside[:, ::-1]  # [measure, set of filters, part]: documents that fail none of the set
    orders, sums = math.factorial(n), np.zeros((n, parts), np.int64)
    out = {name: np.empty((orders, n, parts), np.int64) for name in ("kept", "removed", "good_lost", "toxic_lost")}
    order, before = list(range(n)), [0] * (n + 1)
    for k in range(n):
        before[k + 1] = before[k] | 1 << order[k]
    gone = np.stack([left[:, before[k]] - left[:, before[k + 1]] for k in range(n)])  # [step, measure, part]
    kept = np.stack([left[0, before[k + 1]] for k in range(n)])
    since, visited = [0] * n, [tuple(order)]

    def note(at: int) -> None:
        out["kept"][at] = kept
        for m, name in enumerate(("removed", "good_lost", "toxic_lost")):
            out[name][at] = gone[:, m]

    note(0)
    for at, k in enumerate(neighbour_swaps(n), 1):
        for step in (k, k + 1):  # what these two removed ends here
            sums[order[step]] += gone[step, 0] * (at - since[order[step]])
            since[order[step]] = at
        order[k], order[k + 1] = order[k + 1], order[k]
        before[k + 1] = before[k] | 1 << order[k]
        for step in (k, k + 1):
            gone[step] = left[:, before[step]] - left[:, before[step + 1]]
        kept[k] = left[0, before[k + 1]]
        visited.append(tuple(order))
        note(at)
    for step, f in enumerate(order):
        sums[f] += gone[step, 0] * (orders - since[f])
    which = np.array(visited)
    failing = np.stack([cells[:, (np.arange(full + 1) >> f) & 1 == 1, 0].sum(axis=1) for f in range(n)])
    alone = np.stack([cells[:, 1 << f, 0] for f in range(n)])
    out |= {"redundant": failing[which] - out["removed"], "unique_fails": alone[which], "shapley": sums[which]}
    return visited, out


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _walked(filters: str):
    n = len(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                some = batch.slice(at, PARTS)
                cells = np.zeros((some.num_rows, 1 << n, 3), np.int64)
                for p, held in enumerate(some.column(1).to_pylist()):
                    for cell in held:
                        cells[p, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                orders, found = walk(cells, n)
                names = ["".join(filters[f] for f in order) for order in orders]
                rows, steps = len(orders) * n, np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))
                parts = pa.array(some.column(0).to_pylist(), pa.string()).take(pa.array(np.repeat(np.arange(some.num_rows), rows)))
                columns = [parts, pa.array(np.repeat(names, n).tolist() * some.num_rows), pa.array(np.tile(steps, some.num_rows))]
                columns += [pa.array(found[m].reshape(rows, -1).T.ravel()) for m in MEASURES]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *MEASURES])

    return run


def interactions(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit of rows (part, mask, good, toxic), good and toxic true or false, of any filters (a letter each, few enough for all orders).

    Returns a row for each part, filter_order and step with kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, zeros
    included. Nothing but the counts of masks, at most 2^filters for each part, goes on from the rows. No rows give no rows.
    """
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c)
    cells = failed.groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.select("part", "cells").mapInArrow(_walked(filters), "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of filters A to E over documents(doc_id, text, source) for each source.

    A: under 200 words; B: less than half of the words distinct; C: over 2 % capital letters; D: one of # $ % & * |; E: the text of a
    smaller doc_id. A null text is empty, a null source the part "" as the empty one is. Rows of one doc_id are not copies of each other; a row
    without doc_id is no copy, makes none and has no labels. A document is good or toxic if a row of labels(doc_id, quality, toxic) says 1.
    Rows that stand twice count twice. Other columns are ignored. No rows give no rows.
    """
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    return interactions(masks(documents).join(known, "doc_id", "left"))
