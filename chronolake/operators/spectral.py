"""Spectra of evenly sampled series: Welch's power density and spectrograms. Segments are transformed apart and averaged by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import KEY, finite
from .slices import ranked

SPECTRA = "test_run_id long, channel_name string, segment long, start_ms double, hz double, power double"


def spectrogram(series: DataFrame, size: int = 256, overlap: float = 0.5) -> DataFrame:
    """(test_run_id, channel_name, segment, start_ms, hz, power): the one-sided power density of each segment of `size` samples.

    Segments overlap, are freed of their mean and weighted by a Hann window; the sampling step is the segment's mean step. Samples that are
    not finite are left out, and so is a last segment that is not full.
    """
    if size < 4 or not 0 <= overlap < 1:
        raise ValueError("a segment has at least 4 samples and overlaps by less than itself")
    step = max(1, int(size * (1 - overlap)))
    rows = ranked(series.where(finite(F.col("y"))).select(*KEY, "x_ms", "y"), KEY, "x_ms", "y").withColumnRenamed("_place", "_at").drop("_n")
    # the segments that a sample is in: from the first that reaches it to the last that has begun
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - (size - 1)) / F.lit(float(step))))
    rows = rows.withColumn("segment", F.explode(F.sequence(first.cast("long"), F.floor(F.col("_at") / step).cast("long"))))
    points = F.array_sort(F.collect_list(F.struct("_at", "x_ms", "y"))).alias("points")
    cut = rows.groupBy(*KEY, "segment").agg(points).where(F.size("points") == size)
    cut = cut.select(*KEY, "segment", F.col("points.x_ms").alias("x"), F.col("points.y").alias("y"))
    window = np.hanning(size + 1)[:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for row in batch.itertuples(index=False):
                x, y = np.asarray(row.x, float), np.asarray(row.y, float)
                seconds = (x[-1] - x[0]) / 1000 / (size - 1)
                if seconds <= 0:
                    continue
                power = np.abs(np.fft.rfft((y - y.mean()) * window)) ** 2 * seconds / (window**2).sum()
                power[1 : len(power) - (size % 2 == 0)] *= 2
                parts.append(pd.DataFrame({"test_run_id": row.test_run_id, "channel_name": row.channel_name, "segment": row.segment, "start_ms": x[0], "hz": np.fft.rfftfreq(size, seconds), "power": power}))
            if parts:
                yield pd.concat(parts)

    return cut.mapInPandas(run, SPECTRA)


def power_density(series: DataFrame, size: int = 256, overlap: float = 0.5) -> DataFrame:
    """(test_run_id, channel_name, hz, power, segments): the mean of the segments' densities by their place in the spectrum."""
    spectra = spectrogram(series, size, overlap)
    order = Window.partitionBy(*KEY, "segment").orderBy("hz")
    placed = spectra.withColumn("_bin", F.row_number().over(order))
    return placed.groupBy(*KEY, "_bin").agg(F.avg("hz").alias("hz"), F.avg("power").alias("power"), F.count("*").alias("segments")).drop("_bin")
