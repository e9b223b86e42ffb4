"""Rise, fall and settling times, and the band-pass filter.

A rise begins where a run of samples at or above the lower level begins, and ends at the first later sample of that run at or above the
upper level; a settling is a run of samples inside a band that has lasted long enough. Both are completed stretches. The band-pass
is an affine step for each sample; steps of a slice are composed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import finite
from .slices import completed, cut, in_order


def step_time(df: DataFrame, value: str, out: str, by: list[str], lo: float = 0.1, hi: float = 0.9, falling: bool = False) -> DataFrame:
    """Adds seconds from the lower to the upper level of the last rise (or, falling, from the upper to the lower), else 0.

    df has x_ms and finite values. Levels that both lie in [0, 1] are shares of the run's span; without a span there is no rise.
    """
    c = cut(df, by)
    low, high = F.lit(float(lo)), F.lit(float(hi))
    if not lo < hi:
        low = high = F.lit(None).cast("double")
    elif 0 <= lo <= 1 and 0 <= hi <= 1:
        c = c.over_run({"_least": F.min(value), "_most": F.max(value)})
        low, high = (F.when(F.col("_most") > F.col("_least"), F.col("_least") + share * (F.col("_most") - F.col("_least"))) for share in (low, high))
    x = F.col(value)
    inside, hit = (x <= high, x <= low) if falling else (x >= low, x >= high)
    # the first sample of a stretch can't end it
    return completed(c, inside, hit, lambda at, start: at > start, lambda start: (F.col("x_ms") - start) / 1000, out).drop("_least", "_most")


def settling_time(df: DataFrame, value: str, out: str, by: list[str], band: float = 0.02, hold_s: float = 0.0) -> DataFrame:
    """Adds seconds from leaving the band around the first value until the band around the last has been kept for hold_s."""
    x = F.col(value)
    c = cut(df, by).over_run({"_from": F.min_by(x, F.struct(*in_order(df))), "_to": F.max_by(x, F.struct(*in_order(df))), "_least": F.min(x), "_most": F.max(x)})
    width = F.abs(F.col("_to") - F.col("_from"))
    width = F.when(width > 0, width).otherwise(F.col("_most") - F.col("_least"))
    c = c.with_columns({"_band": F.lit(float(band)) * width if 0 < band <= 1 else F.lit(abs(float(band)))})
    c = c.over_run({"_leaves": F.min(F.when(F.abs(x - F.col("_from")) > F.col("_band"), F.col("x_ms")))})
    inside = (F.col("x_ms") >= F.col("_leaves")) & (F.abs(x - F.col("_to")) <= F.col("_band"))
    kept = lambda at, start: (at - start) / 1000 >= F.lit(max(0.0, float(hold_s)))
    done = completed(c, inside, F.lit(True), kept, lambda _: (F.col("x_ms") - F.col("_leaves")) / 1000, out)
    return done.drop("_from", "_to", "_least", "_most", "_band", "_leaves")


#: Rows whose steps are composed together.
SCAN = 4096


def _composed(keep: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps state = keep * state + add, each composed with all before it, over doubling distances. Shares to keep lie in [0, 1], so
    nothing grows."""
    keep, add = keep.copy(), add.copy()
    for at in range(0, len(keep), SCAN):
        k, a = keep[at : at + SCAN], add[at : at + SCAN]
        step = 1
        while step < len(k):
            a[step:] = k[step:] * a[:-step] + a[step:]
            k[step:] = k[step:] * k[:-step]
            step *= 2
        if at:
            a += k * add[at - 1]
            k *= keep[at - 1]
    return keep, add


def band_pass(df: DataFrame, value: str, dt: str, out: str, by: list[str], low_hz: float, high_hz: float) -> DataFrame:
    """Adds the difference of two first-order low-passes, of the upper and the lower frequency; seconds since the row before are in dt.

    Rows whose value is null or not finite pass through unfiltered and leave the states alone, as do invalid frequencies. One pass in Python
    gives each row the composed steps of its slice up to it; the states before a slice, folded over the slices of its run, are then applied by a
    column. The first value of a run is its first state, which is the same as to begin with that value as the state before it.
    """
    if not (0 < low_hz < high_hz < math.inf):
        return df.withColumn(out, F.col(value))
    times = [1 / (2 * math.pi * high_hz), 1 / (2 * math.pi * low_hz)]
    c = cut(df, by)
    keys = [*by, "_slice"] if c.sliced else list(by)
    rows = c.df.drop("_key")
    names = rows.columns
    v, d, at_keys = names.index(value), names.index(dt), [names.index(k) for k in keys]
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *in_order(df))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, first = None, [(1.0, 0.0), (1.0, 0.0)], None
        for batch in batches:
            x = batch.column(v).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
            seconds = np.maximum(np.nan_to_num(batch.column(d).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)), 1e-6)
            counts = np.isfinite(x)
            found = np.zeros((5, batch.num_rows))
            new = np.zeros(batch.num_rows, bool)
            for k in at_keys:
                code = pc.fill_null(pc.dictionary_encode(batch.column(k)).indices, -1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, z in zip(edges, edges[1:], strict=False):
                if a == z:
                    continue
                key = tuple(batch.column(k)[a].as_py() for k in at_keys)
                if key != now:
                    now, state, first = key, [(1.0, 0.0), (1.0, 0.0)], None
                own = counts[a:z]
                if own.any():
                    first = x[a:z][own][0] if first is None else first
                    for f, time in enumerate(times):
                        share = seconds[a:z][own] / (time + seconds[a:z][own])
                        keep, add = _composed(1 - share, share * x[a:z][own])
                        keep, add = keep * state[f][0], keep * state[f][1] + add
                        found[2 * f, a:z][own], found[2 * f + 1, a:z][own] = keep, add
                        state[f] = float(keep[-1]), float(add[-1])
                found[4, a:z] = np.nan if first is None else first
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f) for f in found)], [*names, "_k0", "_a0", "_k1", "_a1", "_x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    done = ordered.mapInArrow(compose, f"{schema}, _k0 double, _a0 double, _k1 double, _a1 double, _x double")
    good = finite(F.col(value))
    if c.sliced:
        done = done.withColumn("_key", F.struct(*by))
        last = c.latest(F.struct("_k0", "_a0", "_k1", "_a1", "_x"), good)
        each = done.groupBy("_key", "_slice").agg(last.alias("_map")).where("_map is not null")
        run_of = each.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_slice", "_map"))).alias("_all"))  # a row for each slice
        none = F.lit(None).cast("double")
        zero = F.array().cast("array<struct<_slice: bigint, u: double, l: double>>")

        def fold(acc: Column, s: Column) -> Column:
            m, here = s["_map"], F.struct(s["_slice"].alias("_slice"), acc["u"].alias("u"), acc["l"].alias("l"))
            after = [(m[f"_k{f}"] * F.coalesce(acc[n], m["_x"]) + m[f"_a{f}"]).alias(n) for f, n in enumerate("ul")]
            return F.struct(*after, F.concat(acc["before"], F.array(here)).alias("before"))

        states = F.aggregate("_all", F.struct(none.alias("u"), none.alias("l"), zero.alias("before")), fold, lambda acc: acc["before"])
        states = run_of.select("_key", F.explode(states).alias("_b")).select("_key", "_b._slice", F.col("_b.u").alias("_u"), F.col("_b.l").alias("_l"))
        done = done.join(states, ["_key", "_slice"], "left").drop("_key")
    else:
        done = done.withColumns({"_u": F.lit(None).cast("double"), "_l": F.lit(None).cast("double")})
    passed = (F.col("_k0") * F.coalesce("_u", "_x") + F.col("_a0")) - (F.col("_k1") * F.coalesce("_l", "_x") + F.col("_a1"))
    return done.withColumn(out, F.when(good, passed).otherwise(F.col(value))).drop("_slice", "_k0", "_a0", "_k1", "_a1", "_x", "_u", "_l")
