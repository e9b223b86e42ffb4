"""Ingest: files become tests of the catalog and series of the lake, with calculated channels and ranges."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..catalog import store
from ..catalog.store import Catalog
from ..functions.definitions import clean_definition
from ..functions.formula import CalculatedChannel
from ..operators import ranges as range_ops
from ..operators import series as ops
from ..sinks.lake import read_series, write_series
from ..sources import hdf5, tabular, tdms
from ..sources.arrow_ipc import field_units
from ..sources.remote import arrow_schema, first_file, qualified
from .lod import dependency_order
from .query import calculate

RAW, CALCULATED = "raw", "calculated"


@dataclass(frozen=True)
class IngestRule:
    """What an ingest keeps, renames and adds. clean_rule() makes one of a stored dictionary."""

    name: str = ""
    mode: str = "all"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)
    require: tuple[str, ...] = ()
    time_column: str | None = None
    time_unit: str | None = None
    #: Where elapsed times begin; without it they begin at the ingest.
    t0_utc: datetime | None = None
    calculated: tuple[CalculatedChannel, ...] = ()
    range_rules: tuple[int, ...] = ()
    definitions: tuple[dict, ...] = ()
    parameters: dict[str, str | float] = field(default_factory=dict)


def clean_rule(raw: dict) -> IngestRule:
    """An ingest rule of a dictionary as it is stored; raises ValueError on what can't be one."""
    name = str(raw.get("name") or "").strip()
    if not name:
        raise ValueError("an ingest rule needs a name")
    mode = str(raw.get("mode") or "all").strip().lower()
    if mode not in ("all", "include"):
        raise ValueError(f"unknown mode {mode!r}")
    names = lambda key: tuple(dict.fromkeys(s for s in (str(x).strip() for x in raw.get(key) or []) if s))
    rename = {str(k).strip(): str(v).strip() for k, v in (raw.get("rename") or {}).items() if str(k).strip() and str(v).strip()}
    if len(set(rename.values())) < len(rename):
        raise ValueError("two channels would get one name")
    if mode == "include" and not names("include"):
        raise ValueError("a rule that includes channels has to name some")
    unit = raw.get("time_unit") or None
    if unit is not None and unit not in tabular.PER_SECOND:
        raise ValueError(f"unknown time unit {unit!r}")
    t0 = raw.get("t0_utc")
    return IngestRule(
        name, mode, names("include"), names("exclude"), rename, names("require"), str(raw.get("time_column") or "").strip() or None, unit,
        datetime.fromisoformat(t0.replace("Z", "+00:00")) if isinstance(t0, str) else t0, tuple(raw.get("calculated") or ()),
        tuple(int(r) for r in raw.get("range_rules") or ()), tuple(clean_definition(d) for d in raw.get("definitions") or ()), dict(raw.get("parameters") or {}),
    )


def read_normalized(spark: SparkSession, path: str, rule: IngestRule) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """(wide frame with x_ms, column -> channel, channel -> unit) of a file; raises ValueError where it can't be ingested."""
    kind = tabular.detect_format(path)
    return normalized(tabular.read_wide(spark, path), path, rule, kind, units_of_fields(spark, path, kind))


def units_of_fields(spark: SparkSession, path: str, kind: str) -> dict[str, str]:
    """column -> unit by the metadata of a file's fields, which only Arrow and Parquet files have."""
    found = arrow_schema(spark, first_file(spark, path), kind) if kind in ("parquet", "arrow") else None
    return field_units(found) if found is not None else {}


def normalized(wide: DataFrame, path: str, rule: IngestRule, kind: str | None = None, field_units: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """read_normalized() of a wide frame; path is its name in errors. A unit in a header goes before that of the field's metadata."""
    report = tabular.validate(wide, rule.time_column)
    if report["errors"]:
        raise ValueError(f"{path}: {'; '.join(report['errors'])}")
    time_name = report["time_column"]
    renamed, units = tabular.header_units(wide.columns, {time_name})
    units = {renamed.get(c, c): u for c, u in (field_units or {}).items()} | units
    if kind == "h5":
        wide, extra = _hdf5_times(wide, path, rule)
        units |= extra
    else:
        wide, _, _ = tabular.normalize_time(wide, time_name, rule.t0_utc or datetime.now(timezone.utc), rule.time_unit)
    if wide.isEmpty():
        raise ValueError(f"{path}: no time can be read")
    named = {c: renamed.get(c, c) for c in tabular.numeric_columns(wide, {time_name, "x_ms"})}
    chosen = tabular.select_channels(list(named.values()), rule.mode, rule.include, rule.exclude, rule.rename, rule.require)
    channels = {c: chosen[n] for c, n in named.items() if n in chosen}
    return wide, channels, {chosen[n]: u for n, u in units.items() if n in chosen}


def _hdf5_times(wide: DataFrame, path: str, rule: IngestRule) -> tuple[DataFrame, dict[str, str]]:
    """The frame with x_ms by what the file's attributes say of its time, and the units of its datasets."""
    facts = hdf5.time_facts(path)
    units = {d["path"]: d["unit"] for d in hdf5.datasets(path) if d["unit"]}
    unit = rule.time_unit or (facts["unit"] if facts["unit"] != "s" else None)  # seconds may be elapsed or not, which their size tells
    if facts["start_s"] is None or rule.t0_utc is not None:
        return tabular.normalize_time(wide, "time", rule.t0_utc or datetime.now(timezone.utc), unit)[0], units
    wide, _, relative = tabular.normalize_time(wide, "time", None, unit)
    return (wide.withColumn("x_ms", F.col("x_ms") + F.lit(facts["start_s"] * 1000)) if relative else wide), units


def read_series_of(spark: SparkSession, path: str, rule: IngestRule, test_id: int, code: str) -> tuple[DataFrame, list[str]]:
    """(series, channels) of a file of any kind."""
    if tabular.detect_format(path) == "tdms":
        known = [f"{c['group']}/{c['name']}" for c in tdms.channels(path)]
        chosen = tabular.select_channels(known, rule.mode, rule.include, rule.exclude, rule.rename, rule.require)
        rows = ops.renamed(tdms.read_tdms(spark, path, list(chosen), rule.t0_utc), chosen)
        return rows.select(F.lit(test_id).cast("long").alias("test_run_id"), F.lit(code).alias("test_run_code"), "channel_name", "unit", "x_ms", "y"), list(chosen.values())
    wide, channels, units = read_normalized(spark, path, rule)
    return tabular.unpivot(wide, channels, test_id, code, units), list(channels.values())


def channel_rows(series: DataFrame, lake: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """A catalog row for each channel of the series."""
    # by unit first: an aggregate of strings makes every task sort all rows that it reads
    of = series.groupBy(F.col("test_run_id").alias("test_id"), "channel_name", "unit").agg(F.count("y").alias("n"), F.min("x_ms").alias("low"), F.max("x_ms").alias("high"))
    by = of.groupBy("test_id", "channel_name").agg(
        F.first("unit", ignorenulls=True).alias("unit"), F.sum("n").alias("point_count"), F.min("low").alias("start_ms"), F.max("high").alias("end_ms")
    )
    uri = F.concat(F.lit(f"{lake.rstrip('/')}?test_id="), F.col("test_id").cast("string"), F.lit("&channel_name="), F.col("channel_name"))
    return by.select("test_id", "channel_name", F.col("channel_name").alias("display_name"), "unit", uri.alias("parquet_uri"), "point_count", "start_ms", "end_ms")


def materialise(series: DataFrame, lake: str, specs: list[CalculatedChannel]) -> DataFrame:
    """Writes calculated channels of the series into the lake, later ones of earlier ones, and returns them.

    A channel without any value is an error.
    """
    if not specs:
        return series.limit(0)
    ordered = dependency_order(list(specs))
    names = [s.name for s in ordered]
    made = calculate(series, ordered).where(F.col("channel_name").isin(names))
    write_series(made, lake)
    tests = [r[0] for r in series.select("test_run_id").distinct().collect()]  # of an ingest
    written = read_series(series.sparkSession, lake, tests, names)
    have = {r[0] for r in written.select("channel_name").distinct().collect()}
    if missing := [n for n in names if n not in have]:
        raise ValueError(f"calculated channels have no values: {', '.join(missing)}")
    return written


def file_facts(spark: SparkSession, path: str) -> dict:
    found = spark.read.format("binaryFile").load(path).drop("content").first()
    if found is None:
        raise ValueError(f"there is no file {path!r}")
    return {"path": path, "size": found["length"], "modified": found["modificationTime"]}


def is_stale(test: dict, facts: dict) -> bool:
    """Whether a file is no longer the one that a test was made of."""
    return test["source_size"] != facts["size"] or test["source_modified"] != facts["modified"]


def ingest(catalog: Catalog, lake: str, path: str, rule: IngestRule = IngestRule(), run_code: str | None = None, force: bool = False) -> dict:
    """Makes a file a test: its row in the catalog. A file that is known and unchanged is not read again unless forced.

    The order is: check, select, unpivot and write, calculated channels, catalog rows, source range, range rules, definitions. A test
    becomes ready at the end, so a failed ingest leaves none that is.
    """
    kind, facts = tabular.detect_format(path), file_facts(catalog.spark, path)
    known = catalog.artifact_of(path)
    if known and not force and not is_stale(known, facts):
        return known
    artifact, test_id = _ids(catalog.spark, kind, path)
    code = run_code or path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    series, names = read_series_of(catalog.spark, path, rule, test_id, code)
    return _store(catalog, lake, series, names, rule, {"test_id": test_id, "artifact_id": artifact, "run_code": code, "source_path": path, "source_type": kind, "source_size": facts["size"], "source_modified": facts["modified"]})


def ingest_frame(catalog: Catalog, lake: str, wide: DataFrame, name: str, rule: IngestRule = IngestRule()) -> dict:
    """Makes a wide DataFrame a test of the given name, as ingest() does with a file. The same name takes the place of an earlier test."""
    artifact, test_id = _ids(catalog.spark, "frame", name)
    wide, channels, units = normalized(wide, name, rule)
    series = tabular.unpivot(wide, channels, test_id, name, units)
    return _store(catalog, lake, series, list(channels.values()), rule, {"test_id": test_id, "artifact_id": artifact, "run_code": name, "source_path": name, "source_type": "frame"})


def _ids(spark: SparkSession, kind: str, path: str) -> tuple[str, int]:
    ids = spark.range(1).select(store.artifact_id(F.lit(kind), F.lit(path)).alias("a")).withColumn("t", store.test_id(F.col("a"))).first()
    return ids["a"], ids["t"]


def _store(catalog: Catalog, lake: str, series: DataFrame, names: list[str], rule: IngestRule, facts: dict) -> dict:
    """Writes a test's series and all that the catalog has of it."""
    found = _store_all(catalog, lake, series, rule, [facts])
    if not found:
        raise ValueError(f"{facts['source_path']}: no channel has values")
    return found[0]


def _store_all(catalog: Catalog, lake: str, series: DataFrame, rule: IngestRule, facts: list[dict]) -> list[dict]:
    """Writes the series of tests as one part of the lake and all that the catalog has of them; returns the tests that have values.

    Facts are a dictionary for each test, with the same keys.
    """
    spark, ids = catalog.spark, [f["test_id"] for f in facts]
    write_series(series, lake)
    written = read_series(spark, lake, ids).where(~F.col("channel_name").isin([s.name for s in rule.calculated]))
    made = materialise(written, lake, list(rule.calculated))
    everything = written.unionByName(made)
    rows = channel_rows(everything, lake).cache()
    spans = {r["test_id"]: (r["low"], r["high"]) for r in rows.groupBy("test_id").agg(F.min("start_ms").alias("low"), F.max("end_ms").alias("high")).collect()}  # a row for each file
    if not spans:
        return []

    def put(status: str) -> None:
        at = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
        tests, parameters = [], []
        for own in facts:
            if own["test_id"] in spans:
                low, high = spans[own["test_id"]]
                tests.append(own | {"start_time": at(low), "end_time": at(high), "duration_s": (high - low) / 1000, "created_at": datetime.now(timezone.utc), "status": status, "rule": rule.name or None})
                parameters += [(own["test_id"], k, None if isinstance(v, (int, float)) else str(v), float(v) if isinstance(v, (int, float)) else None) for k, v in rule.parameters.items()]
        kinds = spark.createDataFrame([], schema.TESTS).schema
        frame = spark.createDataFrame([tuple(t.values()) for t in tests], kinds.__class__([kinds[k] for k in tests[0]]))
        catalog.register(frame, rows, spark.createDataFrame(parameters, schema.PARAMETERS))

    put("ingesting")
    stale = F.col("test_id").isin(ids) & F.col("source").isin("source", "rule")
    catalog.write("ranges", catalog.read("ranges").where(~F.coalesce(stale, F.lit(False))))
    catalog.ensure_source_ranges(range_ops.source_ranges(everything))
    for rule_id in rule.range_rules:
        catalog.apply_rule(rule_id, everything)
    if rule.definitions:
        catalog.apply_definitions(list(rule.definitions), everything)
    put("ready")
    rows.unpersist()
    tests = {r["test_id"]: r.asDict() for r in catalog.read("tests").where(F.col("test_id").isin(ids)).collect()}
    return [tests[i] for i in ids if i in tests]


def ingest_many(catalog: Catalog, lake: str, paths: list[str], rule: IngestRule = IngestRule()) -> list[dict]:
    """Ingests files, those of one kind with the same columns together; one that fails is reported and the others go on.

    Files that are taken together are read, written and registered by the same few jobs, however many they are; column types are those of all of them. Where
    that fails, and for kinds other than CSV and Parquet, each is ingested by itself.
    """
    out: dict[str, dict] = {}
    groups: dict[tuple, list[str]] = {}
    for path in dict.fromkeys(paths):
        try:
            kind = tabular.detect_format(path)
            columns = tabular.columns_of(catalog.spark, path, kind) if kind in ("csv", "parquet") else None
            groups.setdefault((kind, columns) if columns else (kind, path), []).append(path)
        except (ValueError, PySparkException, Py4JJavaError) as e:  # what the file or its store says
            out[path] = {"path": path, "test_id": None, "error": str(e)}
    for (kind, _), own in groups.items():
        if len(own) > 1:
            try:
                out |= {t["source_path"]: {"path": t["source_path"], "test_id": t["test_id"], "error": None} for t in _ingest_together(catalog, lake, own, kind, rule)}
            except (ValueError, PySparkException):
                pass  # each by itself says which is at fault
        for path in own:
            if path not in out:
                try:
                    out[path] = {"path": path, "test_id": ingest(catalog, lake, path, rule)["test_id"], "error": None}
                except (ValueError, PySparkException) as e:
                    out[path] = {"path": path, "test_id": None, "error": str(e)}
    return [out[p] for p in paths]


def _ingest_together(catalog: Catalog, lake: str, paths: list[str], kind: str, rule: IngestRule) -> list[dict]:
    """The tests of files with the same columns, without those of which no channel has values."""
    spark = catalog.spark
    known = {t["source_path"]: t.asDict() for t in catalog.read("tests").where((F.col("status") == "ready") & F.col("source_path").isin(paths)).collect()}
    asked = {qualified(spark, p): p for p in paths}
    found = spark.read.format("binaryFile").load(paths).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").collect()  # a row for each file
    facts = {asked[qualified(spark, unquote(r["file_path"]))]: r for r in found}
    done = [t for p, t in known.items() if not is_stale(t, {"size": facts[p]["file_size"], "modified": facts[p]["file_modification_time"]})]
    new = [p for p in paths if p not in {t["source_path"] for t in done}]
    if not new:
        return done
    ids = spark.createDataFrame([(p,) for p in new], "path string").select("path", store.artifact_id(F.lit(kind), F.col("path")).alias("a")).withColumn("t", store.test_id(F.col("a"))).collect()
    tests = [
        {"test_id": r["t"], "artifact_id": r["a"], "run_code": r["path"].rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0], "source_path": r["path"], "source_type": kind,
         "source_size": facts[r["path"]]["file_size"], "source_modified": facts[r["path"]]["file_modification_time"]} for r in ids
    ]
    wide = tabular.read_wide(spark, new, kind).withColumn("_file", F.col("_metadata.file_path"))
    by_file = {facts[t["source_path"]]["file_path"]: (t["test_id"], t["run_code"]) for t in tests}
    report = tabular.validate(wide.drop("_file"), rule.time_column)
    if report["errors"]:
        raise ValueError("; ".join(report["errors"]))
    time_name = report["time_column"]
    renamed, units = tabular.header_units(wide.columns, {time_name})
    units = {renamed.get(c, c): u for c, u in units_of_fields(spark, new[0], kind).items()} | units
    placed = tabular.normalize_files(wide, time_name, by_file, rule.t0_utc or datetime.now(timezone.utc), rule.time_unit)
    named = {c: renamed.get(c, c) for c in tabular.numeric_columns(wide, {time_name, "x_ms", "_file"})}
    chosen = tabular.select_channels(list(named.values()), rule.mode, rule.include, rule.exclude, rule.rename, rule.require)
    channels = {c: chosen[n] for c, n in named.items() if n in chosen}
    series = tabular.unpivot(placed, channels, F.col("_test"), F.col("_code"), {chosen[n]: u for n, u in units.items() if n in chosen})
    return done + _store_all(catalog, lake, series, rule, tests)


def ingest_meta(catalog: Catalog, test_id: int) -> dict:
    """What meta.json says of a test: its source, time, channels, ranges and parameters."""
    test = catalog.get_test(test_id)
    if test is None:
        raise ValueError(f"there is no test {test_id}")
    channels = [{"name": r.channel_name, "unit": r.unit, "parquet": r.parquet_uri, "point_count": r.point_count} for r in catalog.channel_entries(test_id).collect()]
    ranges = [{"range_id": r.range_id, "name": r.name, "start_ms": r.start_ms, "end_ms": r.end_ms} for r in catalog.list_ranges(test_id).collect()]
    parameters = {r.key: r.value_text if r.value_num is None else r.value_num for r in catalog.list_parameters(test_id).collect()}
    times = {k: test[k].isoformat() if test[k] else None for k in ("start_time", "end_time")}
    return {
        "schema_version": 1, "run_code": test["run_code"], "source_uri": test["source_path"], "source_type": test["source_type"], "artifact_id": test["artifact_id"],
        "test_id": test_id, "time_bounds": times, "rule_name": test["rule"], "channels": channels, "ranges": ranges, "parameters": parameters,
    }


def write_meta(catalog: Catalog, lake: str, test_id: int) -> str:
    """Writes a test's meta.json below the lake and returns its path."""
    path = f"{lake.rstrip('/')}/meta/{int(test_id)}/meta.json"
    jvm = catalog.spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(catalog.spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(json.dumps(ingest_meta(catalog, test_id), indent=2).encode())
    out.close()
    return path


# --- files that are not in the catalog -----------------------------------------------------------------------------


def file_test(spark: SparkSession, path: str, rule: IngestRule = IngestRule()) -> dict:
    """A row as of a test for a file as it is: first and last time, and duration."""
    wide, _, _ = read_normalized(spark, path, rule)
    low, high = wide.agg(F.min("x_ms"), F.max("x_ms")).first()
    return {"run_code": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "source_path": path, "start_ms": low, "end_ms": high, "duration_s": (high - low) / 1000}


def file_channels(spark: SparkSession, path: str, rule: IngestRule = IngestRule()) -> list[dict]:
    """Name and unit of each channel of a file."""
    _, channels, units = read_normalized(spark, path, rule)
    return [{"channel_name": n, "unit": units.get(n)} for n in channels.values()]


def file_series(spark: SparkSession, path: str, channels: list[str] | None = None, limit: int | None = None, rule: IngestRule = IngestRule()) -> DataFrame:
    """Series of a file as it is, the first `limit` rows of each channel, in time order."""
    wide, chosen, units = read_normalized(spark, path, rule)
    if channels is not None:
        chosen = {c: n for c, n in chosen.items() if n in channels}
        if not chosen:
            raise ValueError(f"{path} has none of the channels")
    rows = tabular.unpivot(wide, chosen, 0, path.rsplit("/", 1)[-1].rsplit(".", 1)[0], units)
    return (ops.head(rows, limit) if limit else rows).orderBy("x_ms", "channel_name")
