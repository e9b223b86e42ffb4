import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.functions import formula
from chronolake.operators import spectral
from chronolake.schema import SERIES


def welch(y, seconds, size, step):
    """The mean of segment densities by plain sums."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    powers = []
    for at in range(0, len(y) - size + 1, step):
        part = (y[at : at + size] - np.mean(y[at : at + size])) * window
        power = [abs(sum(part[k] * np.exp(-2j * np.pi * f * k / size) for k in range(size))) ** 2 * seconds / (window**2).sum() for f in range(size // 2 + 1)]
        powers.append([p * (1 if f == 0 or (f == size // 2 and size % 2 == 0) else 2) for f, p in enumerate(power)])
    return np.mean(powers, axis=0)


@pytest.mark.parametrize("size, overlap", [(16, 0.5), (15, 0.0)])
def test_density_against_sums(spark, size, overlap):
    rnd = np.random.default_rng(3)
    y = np.sin(np.arange(200) * 0.7) + rnd.normal(0, 0.1, 200)
    rows = [(1, "r", "T", "u", k * 250.0, float(v)) for k, v in enumerate(y)] + [(1, "r", "U", "u", 0.0, 1.0), (1, "r", "T", "u", 10.0, float("nan")), (1, "r", "T", "u", 12.0, None)]
    got = spectral.power_density(spark.createDataFrame(rows, SERIES).repartition(3), size, overlap).orderBy("hz").collect()
    want = welch(y, 0.25, size, int(size * (1 - overlap)))
    assert {r.channel_name for r in got} == {"T"} and np.allclose([r.power for r in got], want)
    assert np.allclose([r.hz for r in got], np.fft.rfftfreq(size, 0.25))
    with pytest.raises(ValueError):
        spectral.spectrogram(spark.createDataFrame(rows, SERIES), 2)


def test_mask_by_formula(spark):
    rows = [(1, "r", c, "u", k * 1000.0, float(v)) for c, vs in {"a": [1, 5, 3], "b": [2, 2, 4]}.items() for k, v in enumerate(vs)] + [(1, "r", "c", "u", 1000.0, 9.0), (1, "r", "c", "u", 7000.0, 8.0)]
    series = spark.createDataFrame(rows, SERIES)
    times = lambda **o: sorted((r.channel_name, r.x_ms) for r in formula.mask_by_formula(series, ["a", "b"], "A > B", **o).collect())
    assert times() == [("a", 1000.0), ("b", 1000.0), ("c", 1000.0)]
    assert times(keep_missing=True) == [*times(), ("c", 7000.0)]
    assert formula.mask_by_formula(series.where(F.lit(False)), ["a", "b"], "A > B").count() == 0
