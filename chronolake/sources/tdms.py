"""TDMS files: channels with times of their own. Needs nptdms, which is optional."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

#: Seconds between samples where a channel says nothing of its time, and samples that are read at once: the first is a fixed value.
STEP_S, ROWS = 0.001, 1_000_000


def _nptdms():
    try:
        import nptdms
    except ImportError as e:
        raise ValueError("reading TDMS needs nptdms") from e
    return nptdms


def channels(path: str) -> list[dict]:
    """Group, name and unit of each channel, from the file's metadata."""
    with _nptdms().TdmsFile.open(path) as f:
        return [{"group": g.name, "name": c.name, "unit": str(c.properties.get("unit_string", "") or "") or None} for g in f.groups() for c in g.channels()]


def start_ms(properties: dict, otherwise: datetime) -> float:
    start = properties.get("wf_start_time")
    if start is None:
        start = otherwise
    elif not isinstance(start, datetime):  # a numpy time
        return float(start.astype("datetime64[us]").astype("int64")) / 1000
    return (start if start.tzinfo else start.replace(tzinfo=timezone.utc)).timestamp() * 1000


def read_tdms(spark: SparkSession, path: str, include: list[str] | None = None, t0_utc: datetime | None = None) -> DataFrame:
    """(channel_name, unit, x_ms, y), a task for each channel; a channel is named group/name.

    Its time is its start plus its own track of seconds, or fixed steps. Without a start it begins at t0_utc, or now. Channels of which nothing
    can be read are passed over, as are values that are no numbers; an error behind a channel's first values is raised.
    """
    _nptdms()
    now = t0_utc or datetime.now(timezone.utc)
    wanted = [c for c in channels(path) if include is None or f"{c['group']}/{c['name']}" in include]
    if not wanted:
        raise ValueError("no channels are left")
    listed = spark.createDataFrame([(c["group"], c["name"], c["unit"]) for c in wanted], "group string, name string, unit string")

    def rows(batches):
        import nptdms
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for group, name, unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begun = False
                try:
                    with nptdms.TdmsFile.open(path) as f:
                        channel = f[group][name]
                        begin = start_ms(channel.properties, now)
                        step = channel.properties.get("wf_increment")
                        try:
                            track = np.asarray(channel.time_track(), float)
                        except Exception:  # the channel has no track of its own
                            track = np.zeros(0)
                        n = min(len(channel), len(track)) if len(track) else len(channel)
                        for at in range(0, n, ROWS):
                            y = np.asarray(channel[at : min(at + ROWS, n)], float)
                            seconds = track[at : at + len(y)] if len(track) else (at + np.arange(len(y))) * float(STEP_S if step is None else step)
                            good = ~np.isnan(y)
                            size = int(good.sum())
                            columns = [pa.array([f"{group}/{name}"] * size, pa.string()), pa.array([unit] * size, pa.string()), pa.array((begin + 1000 * seconds)[good]), pa.array(y[good])]
                            begun = True
                            yield pa.RecordBatch.from_arrays(columns, ["channel_name", "unit", "x_ms", "y"])
                except (OSError, KeyError, TypeError, ValueError):
                    if begun:
                        raise

    return listed.repartition(len(wanted)).mapInArrow(rows, "channel_name string, unit string, x_ms double, y double")
