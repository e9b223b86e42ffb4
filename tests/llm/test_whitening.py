import math
import random

import numpy as np

from chronolake.llm import whitening

EXTRA = "component int, n long, deviation long, whitened double, vector string, centred string, place int, total long, label int"
ODD = (1, 2, 3, 0.5, "v", "c", 4, 5, 6)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *ODD) for r in rows], f"vec_id long, embedding array<float>, {EXTRA}").repartition(3)


def brute(rows):
    """Rows by vec_id and the covariance, from whole numbers and from numpy's own decomposition."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = len(kept[0][1])
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in kept], object)
    n, sums = len(kept), x.sum(axis=0)
    numerator = n * x - sums
    deviation = (numerator**2).sum(axis=1)
    centred = (numerator / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(deviation.sum()) / n**3
    return [i for i, _ in kept], deviation, (centred @ vectors) / np.sqrt(np.maximum(values, 1e-300)), values / trace, n, d


def check(rows, got, k=8):
    ids, deviation, whitened, explained, n, d = brute(rows)
    k = min(k, d)
    found = {}
    for r in got.collect():
        found.setdefault(r.vec_id, []).append(r)
        assert r.n == n and r.identity_error <= 1e-4 and abs(r.explained - explained[r.component - 1]) <= 1e-9 * explained[0]
    assert sum(map(len, found.values())) == k * len(ids)
    signs = {}
    for at, i in enumerate(ids):
        own = sorted(found[i], key=lambda r: r.component)
        assert {r.component for r in own} == set(range(1, k + 1)) and all(r.deviation == deviation[at] for r in own)
        for r in own if len(own) == k else []:
            want = whitened[at, r.component - 1]
            if abs(want) > 1e-3:
                sign = signs.setdefault(r.component, 1 if want * r.whitened > 0 else -1)
                assert abs(sign * r.whitened - want) <= 1e-7 * max(1, abs(want))


def test_vectors(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 0.1 + 0.05 * k) for k in range(12)]) for i in range(300)]
    odd = [(400, None), (401, []), (402, [None] + [0.1] * 11), (403, [float("nan")] + [0.1] * 11), (404, [float("inf")] * 12), (405, [-float("inf")] + [0.0] * 11)]
    got = whitening.whiten(frame(spark, rows + odd))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(rows, got)
    check(rows + rows[:40], whitening.whiten(frame(spark, rows + rows[:40])))  # rows that stand twice
    check([(i, v[:3]) for i, v in rows], whitening.whiten(frame(spark, [(i, v[:3]) for i, v in rows] + [(999, [0.5] * 4)])))  # one of another length


def test_total_variance_is_exact(spark):
    """A common shift far larger than the spread changes nothing."""
    rnd = random.Random(9)
    rows = [(i, [900.0 + rnd.random() / 8 * (k + 1) for k in range(9)]) for i in range(200)]
    check(rows, whitening.whiten(frame(spark, rows)))


def test_few_or_equal_rows(spark):
    df = frame(spark, [(1, [0.5, 0.25])])
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df).count() == 0
    assert whitening.whiten(frame(spark, [(i, [0.5, 0.25]) for i in range(5)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    line = whitening.whiten(frame(spark, [(i, [i / 10, i / 5]) for i in range(10)])).collect()  # one direction only
    assert [r.component for r in line].count(1) == 10 and all(r.explained > 0.99 for r in line if r.component == 1)
    none = whitening.whiten(frame(spark, [(None, [0.1, 0.3]), (None, [0.4, 0.2]), (3, [0.9, 0.1])])).collect()
    assert sum(r.vec_id is None for r in none) == 4 and len(none) == 6
