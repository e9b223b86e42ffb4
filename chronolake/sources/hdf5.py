"""HDF5 files: one-dimensional datasets of the length of a shared time dataset. Needs h5py, which is optional.

Attributes of the time dataset (or of the groups around it) tell the unit of its numbers and when elapsed times begin.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from .tabular import MICROSECONDS, MILLISECONDS, NANOSECONDS, TIME_COLUMNS

#: Attributes that hold a unit, and attributes that hold the start of a test.
UNIT_KEYS = ("units", "unit", "Unit", "Units")
START_KEYS = ("StartTime", "start_time", "starttime", "Start_Time", "t0", "T0", "Epoch", "epoch", "wf_start_time", "AbsoluteStart", "absolute_start")
TIME_PATH = "telemetry/TIME"
#: Levels above a dataset that are searched for a start, and rows that a task reads.
LEVELS, ROWS = 4, 1_000_000


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise ValueError("reading HDF5 needs h5py") from e
    return h5py


def _text(value) -> str:
    return (value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)).strip()


def unit_of(node) -> str | None:
    return next((t for key in UNIT_KEYS if key in node.attrs and (t := _text(node.attrs[key]))), None)


def time_unit(text: str | None) -> str | None:
    """s, ms, us or ns for what files call them; None for anything else."""
    word = (text or "").strip().lower()
    if word in ("s", "sec", "second", "seconds"):
        return "s"
    for unit, part, names in (("ns", "nano", ("ns",)), ("ms", "milli", ("ms",)), ("us", "micro", ("us", "usec", "µs"))):
        if part in word or word in names:
            return unit
    return None


def start_seconds(value) -> float | None:
    """Epoch seconds of a start attribute: a date as text, or a number of s, ms, us or ns by its size."""
    if isinstance(value, (bytes, str)):
        try:
            at = datetime.fromisoformat(_text(value).replace("Z", "+00:00"))
        except ValueError:
            return None
        return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp()
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return number / (1e9 if number > NANOSECONDS else 1e6 if number > MICROSECONDS else 1e3 if number > MILLISECONDS else 1)


def _find_start(node) -> float | None:
    for _ in range(LEVELS):
        for key in START_KEYS:
            if key in node.attrs and (found := start_seconds(node.attrs[key])) is not None:
                return found
        node = getattr(node, "parent", None)
        if node is None or getattr(node, "name", "/") == "/":
            return None
    return None


def datasets(path: str) -> list[dict]:
    """The datasets of a file: path, unit, length, and whether each can be the time or a channel."""
    h5py, out = _h5py(), []
    times = {t.lower() for t in TIME_COLUMNS}

    def visit(name: str, node) -> None:
        if isinstance(node, h5py.Dataset):
            numeric = len(node.shape) == 1 and node.shape[0] > 0 and node.dtype.kind in "iuf"
            is_time = name.endswith("TIME") or name.rsplit("/", 1)[-1].lower() in times
            out.append({"path": name, "unit": unit_of(node), "n": node.shape[0] if node.shape else 0, "is_time": numeric and is_time, "is_channel": numeric and not is_time})

    with h5py.File(path) as f:
        f.visititems(visit)
    return out


def time_facts(path: str, time_path: str = TIME_PATH) -> dict:
    """unit of the time dataset and start_s, when elapsed times begin; None where the file doesn't say."""
    with _h5py().File(path) as f:
        if time_path not in f:
            raise ValueError(f"there is no time dataset {time_path!r}")
        node = f[time_path]
        parent = getattr(node, "parent", None)
        unit = time_unit(unit_of(node)) or (time_unit(unit_of(parent)) if parent is not None else None)
        return {"unit": unit, "start_s": _find_start(node)}


def read_hdf5(spark: SparkSession, path: str, time_path: str = TIME_PATH) -> DataFrame:
    """A wide frame of the time dataset, as time, and the numeric datasets of its length by their paths; each task reads a slice of rows."""
    _h5py()
    found = {d["path"]: d for d in datasets(path)}
    time = found.get(time_path)
    if time is None or not (time["is_time"] or time["is_channel"]):
        raise ValueError(f"there is no time dataset {time_path!r}")
    n = time["n"]
    names = [time_path, *(p for p, d in found.items() if p != time_path and d["n"] == n and (d["is_channel"] or d["is_time"]))]
    if len(names) < 2:
        raise ValueError("no numeric dataset has the length of the time dataset")
    titles = ["time", *names[1:]]

    def rows(batches):
        import h5py
        import pyarrow as pa

        for batch in batches:
            for start in batch.column(0).to_pylist():
                with h5py.File(path) as f:
                    data = [pa.array(f[name][start : start + ROWS].astype("float64")) for name in names]
                yield pa.RecordBatch.from_arrays(data, titles)

    return spark.range(0, n, ROWS).mapInArrow(rows, ", ".join(f"`{t}` double" for t in titles))
