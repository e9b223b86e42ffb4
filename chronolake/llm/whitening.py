"""Whitening of embeddings by the singular value decomposition of the centred rows, which Spark MLlib takes over distributed rows.

Entries are whole numbers x, so counts, sums and deviations are exact: the numerators n * x - S of the centred entries are whole, and the total
variance is the sum of their squares over n^3, whatever the decomposition says. A singular value s of the centred rows is an
eigenvalue s^2 / n of their covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

STEP, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Singular values under this share of the largest are no components: their eigenvalues (squares) are lost in rounding.
LEAST = 1e-6
#: Rows that are multiplied together.
ROWS = 4096


def _entries(vectors: pa.Array) -> np.ndarray:
    """[row, dimension] of x = floor(1024 * c) + 100000. Entries too large for exact sums raise an error."""
    flat = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    low, high = (flat.min(), flat.max()) if len(flat) else (0, 0)
    if max(-low, high) * STEP > 2**52:
        raise OverflowError("an embedding has an entry that is too large for exact sums")
    x = np.floor(flat * STEP).astype(np.int64) + SHIFT
    return x.reshape(len(vectors), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            x = _entries(batch.column(0).slice(at, ROWS))
            columns = [pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array(x.sum(axis=0)), pa.array(np.full(x.shape[1], len(x), np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["place", "total", "n"])


@dataclass
class Model:
    n: int
    sums: np.ndarray  # long, by dimension
    components: np.ndarray  # [component, dimension], unit length
    eigenvalues: np.ndarray
    variance: float  # the trace of the covariance


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows whose vector is not null, holds only finite numbers and has the commonest length (of those the longest)."""
    c = F.col("embedding")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.where(c.isNotNull() & (F.size(c) > 0)).where(~bad).select("vec_id", c.alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    return rows.where(F.size("vector") == F.lit(lengths[0]["length"] if lengths else 0))


def _centred(sums: np.ndarray, n: int):
    """Rows to vec_id, deviation and the centred vector; numerators and deviations are whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x = _entries(some.column(1))
                top = n * max(abs(int(x.max())), abs(int(x.min()))) + int(np.abs(sums).max())
                if top >= 2**62:
                    raise OverflowError("too many rows for deviations of 64 bits")
                numerator = n * x - sums
                size = float((numerator.astype(float) ** 2).sum(axis=1).max())
                if size > 9e18:
                    raise OverflowError("a deviation does not fit into 64 bits")
                deviation = (numerator * numerator).sum(axis=1)
                centred = (numerator / n).ravel()
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, centred.size + 1, x.shape[1], dtype=np.int32)), pa.array(centred))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(deviation), vectors], ["vec_id", "deviation", "centred"])

    return run


def centre(rows: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """(vec_id, deviation, centred) of usable rows, and the sums and the count behind them: a number for each dimension goes to the driver."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    totals = rows.select("vector").mapInArrow(_sums, "place int, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("place").collect()
    sums, n = np.array([r["total"] for r in totals], np.int64), totals[0]["n"] if totals else 0
    return rows.select("vec_id", "vector").mapInArrow(_centred(sums, n), f"vec_id {kind}, deviation long, centred array<double>"), sums, n


def fit(centred: DataFrame, sums: np.ndarray, n: int, k: int = COMPONENTS) -> Model:
    """The first k components of the centred rows. All singular values are asked for: MLlib then decomposes the matrix of products by
    a dense method of full precision instead of an iteration with a tolerance."""
    vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("centred").alias("v")), "v")
    squares = int(centred.agg(F.sum(F.col("deviation").cast("decimal(38,0)"))).first()[0] or 0)
    d = len(sums)
    if not squares:  # all rows are equal: no component
        return Model(n, sums, np.zeros((0, d)), np.zeros(0), 0.0)
    found = RowMatrix(vectors, numRows=n, numCols=d).computeSVD(d, computeU=False, rCond=LEAST)
    values = found.s.toArray() ** 2 / n
    return Model(n, sums, found.V.toArray().T[:k], values[:k], squares / n**3)


def _projected(model: Model):
    weights = (model.components / np.sqrt(model.eigenvalues)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                own = some.column(2).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1) @ weights
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, max(own.shape[1], 1), dtype=np.int32)), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), vectors], ["vec_id", "deviation", "whitened"])

    return run


def _products(means: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.column(0).slice(at, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(means)) - means
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(means) ** 2, dtype=np.int32)), pa.array((own.T @ own).ravel())], ["place", "total"])

    return run


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of column `whitened`, centred before multiplying, minus the identity."""
    means = np.array(whitened.agg(*[F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k)]).first(), float)
    sums = whitened.select("whitened").mapInArrow(_products(means), "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()
    return float(np.abs(np.array([r["total"] for r in sums]).reshape(k, k) / n - np.eye(k)).max())


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """embeddings(vec_id, embedding) whitened over all usable rows.

    A row whose vector is null, empty, or holds null or non-finite entries is dropped, and so is one of another length than the commonest (of
    equally common ones the longest). Returns for each other row and each of the first k components: vec_id, component (from 1, by falling
    eigenvalue), n, deviation (exact), whitened, explained, identity_error. Directions whose eigenvalue is under 1e-12 of the largest are no
    components; rows that are all equal, or a single row, have none and give no rows. Equal eigenvalues come in the order of the
    decomposition. Rows that stand twice count twice and give rows twice; vec_id may be null. Entries beyond 2^42, or deviations beyond 64 bits,
    raise an error. Other columns are ignored. No rows give no rows.
    """
    centred, sums, n = centre(usable(embeddings))
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    model = fit(centred, sums, n, k) if n else None
    found = len(model.eigenvalues) if n else 0
    if not found:
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = stored(centred.mapInArrow(_projected(model), f"vec_id {kind}, deviation long, whitened array<double>"), "whitened")
    error = identity_error(rows, n, found)
    explained = F.array(*[F.lit(float(e) / model.variance) for e in model.eigenvalues])
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"),
    )
