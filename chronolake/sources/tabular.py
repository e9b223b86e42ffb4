"""Wide tables (CSV, Parquet, Arrow) to series: time column, time unit, header units, channels, unpivot."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SERIES_COLUMNS
from .remote import arrow_schema, first_file, first_line

#: Names of time columns in order of preference, and formats by extension: fixed values.
TIME_COLUMNS = ["timestamp_utc", "time", "timestamp", "datetime", "time_s", "x_ms", "TIME"]
FORMATS = {
    ".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".arrow": "arrow", ".arrows": "arrow", ".feather": "arrow",
    ".h5": "h5", ".hdf5": "h5", ".tdms": "tdms",
}
PER_SECOND = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}
#: Below this many seconds a number is elapsed time, not an epoch.
EPOCH = 1e8
# Above how great a number, and within how great a span, times count nano-, micro- or milliseconds since the epoch; and
# below how great a number, by unit, they are elapsed times; seconds up to the very number.
NANOSECONDS, NANOSECONDS_IN, NANOSECONDS_SPAN, MICROSECONDS, MILLISECONDS = 1e17, 1e14, 1e11, 1e14, 1e11
ELAPSED = {"s": EPOCH, "ms": 1e11, "us": 1e14, "ns": 1e17}


def detect_format(path: str) -> str:
    extension = PurePosixPath(path).suffix.lower()
    if extension not in FORMATS:
        raise ValueError(f"unsupported file type {extension!r}")
    return FORMATS[extension]


def read_wide(spark: SparkSession, path: str | list[str], kind: str | None = None) -> DataFrame:
    """A file, or several of one kind with the same columns (CSV and Parquet)."""
    kind = kind or detect_format(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind == "parquet":
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    if kind == "arrow":
        from .arrow_ipc import read_arrow

        return read_arrow(spark, path)
    if kind == "h5":
        from .hdf5 import read_hdf5

        return read_hdf5(spark, path)
    raise ValueError(f"{kind} files are no wide tables")


def columns_of(spark: SparkSession, path: str, kind: str) -> tuple[str, ...]:
    """What tells files apart that can't be read together: the header of a CSV file, names and types of a Parquet file."""
    if kind == "csv":
        return (first_line(spark, path),)
    found = arrow_schema(spark, first_file(spark, path), kind)
    return tuple(f"{f.name} {f.type} {sorted((f.metadata or {}).items())}" for f in found) if found is not None else ()


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, size, modified) of the supported files below a folder, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).drop("content")
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    known = files.withColumn("format", F.try_element_at(kinds, extension)).where("format is not null")
    return known.select("path", "format", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def time_column(columns: list[str], override: str | None = None) -> str | None:
    """The override where it is a column, else the first known name; case counts only where both forms exist."""
    lower = {c.lower(): c for c in reversed(columns)}
    for name in [override] if override else TIME_COLUMNS:
        if name in columns:
            return name
        if name.lower() in lower:
            return lower[name.lower()]
    return None


def _name_and_unit(header: str) -> tuple[str, str] | None:
    """What a header that ends in brackets of one kind says; the unit holds no brackets itself."""
    text = header.strip()
    for first, last in ("()", "[]"):
        name, opened, unit = text.removesuffix(last).rpartition(first)
        if text.endswith(last) and opened and name.strip() and unit.strip() and not set("()[]") & set(unit):
            return name.strip(), unit.strip()
    return None


def header_units(columns: list[str], skip: set[str] = frozenset()) -> tuple[dict[str, str], dict[str, str]]:
    """(column -> channel, channel -> unit) for headers such as `THRUST (N)` and `P[psi]`; repeated names get _2, _3, ..."""
    renamed, units, seen = {}, {}, {}
    for c in columns:
        found = None if c in skip else _name_and_unit(c)
        if not found:
            continue
        name, unit = found
        seen[name] = seen.get(name, 0) + 1
        name = name if seen[name] == 1 else f"{name}_{seen[name]}"
        renamed[c], units[name] = name, unit
    return renamed, units


@dataclass(frozen=True)
class TimeScale:
    unit: str
    relative: bool
    padded: bool
    least: float


def time_scale(low: float, high: float, unit: str | None = None) -> TimeScale:
    """Unit of a numeric time column from its least and greatest value, whether it is elapsed time, and whether unset slots pad it."""
    if unit is None:
        if high > NANOSECONDS or high > NANOSECONDS_IN and high - low <= NANOSECONDS_SPAN:
            unit = "ns"
        elif high > MICROSECONDS:
            unit = "us"
        else:
            unit = "ms" if high > MILLISECONDS else "s"
        relative = high <= EPOCH and low >= 0
    else:
        relative = low >= 0 and (high < ELAPSED[unit] or unit == "s" and high == EPOCH)
    return TimeScale(unit, relative, high > EPOCH > low, low)


def normalize_time(df: DataFrame, time_col: str | None = None, t0_utc: datetime | None = None, unit: str | None = None) -> tuple[DataFrame, str, bool]:
    """df with x_ms, the name of its time column and whether that is elapsed time, which is then anchored at t0_utc if given.

    Numeric times keep their fractions to the microsecond. Rows whose time can't be read are dropped; order is left to the reader.
    """
    name = time_column(df.columns, time_col)
    if not name:
        raise ValueError(f"a time column is required ({', '.join(TIME_COLUMNS)}) or one must be named")
    kind, raw = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        number = raw.cast("double")
        low, high = df.agg(F.min(number), F.max(number)).first()  # one pass over one column
        if low is None:
            raise ValueError("the file has no data rows")
        scale = time_scale(low, high, unit or ("ms" if name == "x_ms" else None))
        df = df.where(number.isNotNull() & ~F.isnan(number))
        if scale.padded:
            df = df.where(number > EPOCH)
        micros = F.floor(number / F.lit(PER_SECOND[scale.unit] / 1e6) + 0.5)
        shift = 0.0
        if scale.relative and t0_utc is not None:
            at = t0_utc if t0_utc.tzinfo else t0_utc.replace(tzinfo=timezone.utc)
            shift = at.timestamp() * 1000 - low * 1000 / PER_SECOND[scale.unit]
        return df.withColumn("x_ms", micros / 1000 + F.lit(shift)), name, scale.relative
    at = raw.cast("timestamp") if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.try_to_timestamp(raw.cast("string"))
    return df.withColumn("x_ms", F.unix_micros(at) / 1000).where(F.col("x_ms").isNotNull()), name, False


def normalize_files(wide: DataFrame, name: str, tests: dict[str, tuple[int, str]], t0_utc: datetime, unit: str | None = None) -> DataFrame:
    """normalize_time() of the rows of many files (column _file), each by its own least and greatest time, with the _test and _code of their file.

    Facts of a file are a row; there are as many as files were named.
    """
    raw = F.col(f"`{name}`")
    numeric = isinstance(wide.schema[name].dataType, T.NumericType)
    facts = []
    if numeric:
        number = raw.cast("double")
        for r in wide.groupBy("_file").agg(F.min(number).alias("low"), F.max(number).alias("high")).collect():
            if r["low"] is not None:
                scale = time_scale(r["low"], r["high"], unit or ("ms" if name == "x_ms" else None))
                shift = t0_utc.timestamp() * 1000 - r["low"] * 1000 / PER_SECOND[scale.unit] if scale.relative else 0.0
                facts.append((r["_file"], *tests[r["_file"]], PER_SECOND[scale.unit] / 1e6, shift, scale.padded))
        wide = wide.where(number.isNotNull() & ~F.isnan(number))
    else:
        wide, _, _ = normalize_time(wide, name)
        facts = [(f, *t, 1.0, 0.0, False) for f, t in tests.items()]
    known = wide.sparkSession.createDataFrame(facts, "_file string, _test long, _code string, _scale double, _shift double, _padded boolean")
    met = wide.join(F.broadcast(known), "_file")
    if numeric:
        met = met.where(~F.col("_padded") | (number > EPOCH)).withColumn("x_ms", F.floor(number / F.col("_scale") + 0.5) / 1000 + F.col("_shift"))
    return met.drop("_scale", "_shift", "_padded")


def select_channels(available: list[str], mode: str = "all", include=(), exclude=(), rename: dict | None = None, require=()) -> dict[str, str]:
    """source column -> channel for the columns to keep. Names to include may be columns or the names they get."""
    rename = {k.strip(): v.strip() for k, v in (rename or {}).items()}
    back = {v: k for k, v in rename.items()}
    wanted = {n if n in available else back.get(n) for n in map(str.strip, include)}
    kept = [c for c in available if c not in {e.strip() for e in exclude} and (mode != "include" or c in wanted)]
    chosen = {c: rename.get(c, c) for c in kept}
    if missing := [r for r in map(str.strip, require) if r and r not in chosen and r not in chosen.values()]:
        raise ValueError(f"required channels are missing: {', '.join(missing)}")
    if not chosen:
        raise ValueError("no channels are left")
    return chosen


def numeric_columns(df: DataFrame, skip: set[str] = frozenset()) -> list[str]:
    """Columns that can be channels; booleans are not numbers."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def unpivot(df: DataFrame, channels: dict[str, str], test_id: int | Column, run_code: str | Column, units: dict[str, str] | None = None) -> DataFrame:
    """A wide frame with x_ms as series; null values are left out. One projection, no shuffle."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    units = units or {}
    values = [
        F.struct(F.lit(name).alias("channel_name"), F.lit(units.get(name)).cast("string").alias("unit"), F.col(f"`{c}`").cast("double").alias("y"))
        for c, name in channels.items()
    ]
    rows = df.select(as_column(test_id).cast("long").alias("test_run_id"), as_column(run_code).alias("test_run_code"), "x_ms", F.explode(F.array(*values)).alias("v"))
    return rows.select("test_run_id", "test_run_code", "v.channel_name", "v.unit", "x_ms", "v.y").where("x_ms is not null and y is not null").select(*SERIES_COLUMNS)


def probe(df: DataFrame, units: dict[str, str] | None = None) -> dict:
    """Channels with their non-null counts, time candidates, and how far units are known: one pass of counts."""
    known = {t.lower() for t in TIME_COLUMNS}
    times = [c for c in df.columns if c.lower() in known]
    names = [c for c in numeric_columns(df) if c not in times]
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    channels = [{"name": c, "n": counted[f"c{i}"]} for i, c in enumerate(names) if counted[f"c{i}"]]
    with_unit = sum(1 for c in channels if (units or {}).get(c["name"]))
    coverage = "na" if not channels else "ok" if with_unit == len(channels) else "partial" if with_unit else "missing"
    return {"rows": counted["rows"], "time_candidates": times, "channels": channels, "unit_coverage": coverage}


def validate(df: DataFrame, time_col: str | None = None) -> dict:
    """Errors and warnings before an ingest."""
    errors, warnings = [], []
    name = time_column(df.columns, time_col)
    if not name:
        errors.append("no time column")
    if not numeric_columns(df, {name} if name else set()):
        errors.append("no numeric channel columns")
    rows = df.limit(2).count()
    if rows == 0:
        errors.append("no data rows")
    elif rows == 1:
        warnings.append("a single data row")
    return {"ok": not errors, "errors": errors, "warnings": warnings, "time_column": name}
