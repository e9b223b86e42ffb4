"""The catalog: dimension tables in Parquet folders under an optimistic commit log.

Tables have a row for each test, channel, range, ...; a small one is a file, a large one several. A change sees one version throughout, stages its folders and commits them as the
next version; if another writer has won that, the change is made again on what is now the newest. Rows that are added are a folder of
their own, and a table of many folders is compacted by the next change of it. Readers see whole versions.
"""

from __future__ import annotations

import json
import random
import threading
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.definitions import parse_config
from ..operators import ranges as ops
from ..session import durable
from ..sinks.lake import delete_tests
from .log import EMPTY, CommitLog

TABLES = {
    "tests": schema.TESTS, "channels": schema.CHANNELS, "parameters": schema.PARAMETERS, "ranges": schema.RANGES,
    "range_parameters": schema.RANGE_PARAMETERS, "range_rules": schema.RANGE_RULES, "results": schema.RESULTS,
}
#: Versions whose folders stay for readers that have begun, folders of a table before it is compacted, and attempts of a change.
KEPT, MOST_FOLDERS, ATTEMPTS = 3, 12, 50
#: The parameter that holds a test's icon.
ICON = "ui_icon"


class Conflict(RuntimeError):
    """Other writers have won every version that a change has tried for."""


class _Change:
    """What a change sees (a version) and what it has staged."""

    def __init__(self, version: int, content: dict):
        self.version, self.staged = version, []
        self.tables = {t: list(f) for t, f in content["tables"].items()}
        self.ids = dict(content["ids"])


def changes(method: Callable) -> Callable:
    """A method whose reads and writes are one change of the catalog. Within another change it is part of that."""

    @wraps(method)
    def run(self: Catalog, *args, **kw):
        if self._change is not None:
            return method(self, *args, **kw)
        for attempt in range(ATTEMPTS):
            change = self._local.change = _Change(*self.log.latest())
            try:
                out = method(self, *args, **kw)
                if not change.staged:
                    return out
                won = self.log.commit(change.version + 1, {"tables": change.tables, "ids": change.ids})
            except BaseException:
                self._discard(change)
                raise
            finally:
                self._local.change = None
            if won:
                self._expire(change.version + 1)
                return out
            self._discard(change)
            time.sleep(random.uniform(0, 0.05 * (attempt + 1)))
        raise Conflict(f"{method.__name__}: {ATTEMPTS} attempts were overtaken")

    return run


class Catalog:
    """Each thread's changes are its own, also with one Catalog."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log, self._local = CommitLog(spark, root), threading.local()

    @property
    def _change(self) -> _Change | None:
        return getattr(self._local, "change", None)

    def read(self, table: str) -> DataFrame:
        """The table in the newest version, or in that of the change; columns that its folders lack are null, so schemas may grow."""
        folders = self._change.tables.get(table) if self._change else self.log.latest()[1]["tables"].get(table)
        wanted = TABLES[table]
        if not folders:
            return self.spark.createDataFrame([], wanted)
        return self.spark.read.schema(wanted).parquet(*[f"{self.root}/{f}" for f in folders])

    def _stage(self, table: str, rows: DataFrame) -> str:
        wanted = self.spark.createDataFrame([], TABLES[table]).schema
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields]
        folder = f"{table}/{uuid.uuid4().hex}"
        self._change.staged.append(folder)
        rows.select(*columns).hint("rebalance").write.parquet(f"{self.root}/{folder}")
        return folder

    def _discard(self, change: _Change) -> None:
        for folder in change.staged:
            self.log.delete(f"{self.root}/{folder}")

    def _expire(self, version: int) -> None:
        """Deletes the folders that the version which has just left the kept ones was the last to have."""
        old = self.log.read(version - KEPT) if version > KEPT else None
        if old:
            folders = lambda content: {f for t in (content or EMPTY)["tables"].values() for f in t}
            for folder in folders(old) - set().union(*(folders(self.log.read(v)) for v in range(version - KEPT + 1, version + 1))):
                self.log.delete(f"{self.root}/{folder}")

    @changes
    def write(self, table: str, rows: DataFrame) -> None:
        """Puts rows in place of the table."""
        self._change.tables[table] = [self._stage(table, rows)]

    @changes
    def append(self, table: str, rows: DataFrame, id_column: str | None = None) -> DataFrame:
        """Adds rows to the table, numbered if an id column is named, and returns them."""
        if id_column:
            rows = durable(self.with_new_ids(table, rows, id_column))
        folders = self._change.tables.get(table, [])
        if len(folders) >= MOST_FOLDERS:
            folders = [self._stage(table, self.read(table))]
        self._change.tables[table] = [*folders, self._stage(table, rows)]
        return rows

    def with_new_ids(self, table: str, rows: DataFrame, id_column: str) -> DataFrame:
        """rows numbered behind all ids that the table has or ever gave."""
        numbered = durable(with_ids(rows, self.read(table), id_column, self._change.ids.get(table, 0)))
        self._gave(table, numbered, id_column)
        return numbered

    def _gave(self, table: str, rows: DataFrame, id_column: str) -> None:
        self._change.ids[table] = max(self._change.ids.get(table, 0), rows.agg(F.max(id_column)).first()[0] or 0)

    # --- tests, channels, parameters ---

    @changes
    def register(self, test: DataFrame, channels: DataFrame, parameters: DataFrame) -> None:
        """Puts a test, its channels and parameters in place of what the catalog had of the same test."""
        ids = test.select("test_id")
        for table, rows in (("tests", test), ("channels", channels), ("parameters", parameters)):
            old = self.read(table)
            self.write(table, old.join(ids, "test_id", "left_anti").select(*old.columns).unionByName(rows, allowMissingColumns=True))

    def get_test(self, test_id: int | None = None, artifact_id: str | None = None) -> dict | None:
        """The test of an id, or the newest one of an artifact."""
        tests = self.read("tests")
        own = tests.where(F.col("test_id") == test_id) if test_id is not None else tests.where(F.col("artifact_id") == artifact_id)
        found = latest_tests(own, 1).first()
        return found.asDict() if found else None

    def artifact_of(self, path: str) -> dict | None:
        """The ready test that was made of a file."""
        found = latest_tests(self.read("tests").where((F.col("source_path") == path) & (F.col("status") == "ready")), 1).first()
        return found.asDict() if found else None

    def channel_entries(self, test_id: int, names: list[str] | None = None) -> DataFrame:
        return channel_entries(self.read("channels"), test_id, names)

    def latest_tests(self, limit: int) -> DataFrame:
        return latest_tests(self.read("tests"), limit)

    def list_tests(self, limit: int | None = None) -> DataFrame:
        """The tests with their icons: all, or the newest ones."""
        return with_icons(latest_tests(self.read("tests"), limit), self.read("parameters"))

    def list_parameters(self, test_id: int) -> DataFrame:
        return self.read("parameters").where(F.col("test_id") == test_id).orderBy("key")

    def counts(self) -> DataFrame:
        return table_counts(self.read("tests"), self.read("channels"))

    @changes
    def update_test(self, test_id: int, run_code: str | None = None, notes: str | None = None, icon: str | None = None) -> dict:
        """Renames a test, sets its notes or its icon; an empty icon is taken away."""
        if self.get_test(test_id) is None:
            raise ValueError(f"there is no test {test_id}")
        if run_code is not None and not run_code.strip():
            raise ValueError("a run code can't be empty")
        own = F.col("test_id") == test_id
        tests = self.read("tests")
        for column, value in (("run_code", run_code and run_code.strip()), ("notes", notes)):
            if value is not None:
                tests = tests.withColumn(column, F.when(own, F.lit(value)).otherwise(F.col(column)))
        self.write("tests", tests)
        if icon is not None:
            parameters = self.read("parameters").where(~(own & (F.col("key") == ICON)))
            if icon.strip():
                parameters = parameters.unionByName(self.spark.createDataFrame([(test_id, ICON, icon.strip(), None)], schema.PARAMETERS))
            self.write("parameters", parameters)
        return self.get_test(test_id)

    @changes
    def delete_test(self, test_id: int, lake: str | None = None) -> None:
        """Deletes a test with all that belongs to it, and its series of the lake if that is named."""
        ranges = self.read("ranges")
        gone = ranges.where(F.col("test_id") == test_id).select("range_id")
        parameters = self.read("range_parameters")
        self.write("range_parameters", parameters.join(gone, "range_id", "left_anti").select(*parameters.columns))
        for table in ("tests", "channels", "parameters", "ranges", "results"):
            self.write(table, self.read(table).where(F.col("test_id") != test_id))
        if lake:
            delete_tests(self.spark, lake, [int(test_id)])

    # --- ranges ---

    @changes
    def create_ranges(self, new: DataFrame) -> DataFrame:
        """Adds ranges(test_id, name, start_ms, end_ms, ...) and returns them with their ids and parents.

        Ranges without a parent get their test's source range where they lie inside it. Nothing is added if any can't have its parent, or if
        a second source range would come to a test. A source range becomes the parent of the roots inside it.
        """
        old = self.read("ranges")
        added = durable(place_ranges(new, old, self._change.ids.get("ranges", 0)))
        self._gave("ranges", added, "range_id")
        if faulty := added.where("fault is not null").select("name", "fault").first():
            raise ValueError(f"range {faulty.name!r}: {faulty.fault}")
        added = added.drop("fault")
        if added.where("source = 'source'").isEmpty():
            self.append("ranges", added)
            return added
        rows = old.unionByName(added, allowMissingColumns=True).select(*old.columns)
        sources = rows.where("source = 'source'").withColumnRenamed("test_id", "test_run_id")
        made = added.where("source = 'source'").select(F.col("test_id").alias("test_run_id")).distinct()
        as_runs = rows.withColumnRenamed("test_id", "test_run_id")
        adopted = ops.adopt(as_runs, sources.join(made, "test_run_id", "left_semi").select("range_id", "test_run_id", "start_ms", "end_ms"))
        self.write("ranges", adopted.withColumnRenamed("test_run_id", "test_id"))
        return added

    @changes
    def create_range(self, test_id: int, name: str, start_ms: float, end_ms: float, parameters: dict | None = None, **other) -> dict:
        row = {"test_id": test_id, "name": name, "start_ms": float(start_ms), "end_ms": float(end_ms), "source": "user"} | other
        kinds = self.spark.createDataFrame([], schema.RANGES).schema
        own = self.spark.createDataFrame([tuple(row.values())], kinds.__class__([kinds[k] for k in row]))
        made = self.create_ranges(own).first().asDict()
        if parameters:
            self._put_range_parameters(made["range_id"], parameters)
        return self.get_range(made["range_id"])

    def _put_range_parameters(self, range_id: int, parameters: dict) -> None:
        rows = [(range_id, str(k), None if isinstance(v, (int, float)) else str(v), float(v) if isinstance(v, (int, float)) else None) for k, v in parameters.items()]
        left = self.read("range_parameters").where(F.col("range_id") != range_id)
        self.write("range_parameters", left.unionByName(self.spark.createDataFrame(rows, schema.RANGE_PARAMETERS)))

    @changes
    def ensure_source_ranges(self, spans: DataFrame) -> DataFrame:
        """Gives the tests of spans(test_run_id, start_ms, end_ms) that have no source range one over their whole time."""
        have = self.read("ranges").where("source = 'source'").select(F.col("test_id").alias("test_run_id"))
        new = spans.join(have, "test_run_id", "left_anti").select(F.col("test_run_id").alias("test_id"), F.lit("Source").alias("name"), "start_ms", "end_ms", F.lit("source").alias("source"))
        return self.create_ranges(new)

    def list_ranges(self, test_id: int | None = None) -> DataFrame:
        """Ranges by time with their parameters. A lone root with the id 1 that users made counts as the source range of a test that has none."""
        rows = promote_legacy(self.read("ranges"))
        rows = rows if test_id is None else rows.where(F.col("test_id") == test_id)
        return with_range_parameters(rows, self.read("range_parameters")).orderBy("start_ms", "range_id")

    def get_range(self, range_id: int) -> dict | None:
        found = with_range_parameters(self.read("ranges").where(F.col("range_id") == range_id), self.read("range_parameters")).first()
        return found.asDict(recursive=True) if found else None

    @changes
    def update_range(self, range_id: int, parameters: dict | None = None, **changes) -> dict:
        """Changes a range. The bounds of a source range are locked and it has no parent; another one must stay inside its parent.

        parent_range_id=None takes the parent away; the test's source range then stands in where the range lies inside it.
        """
        now = self.get_range(range_id)
        if now is None:
            raise ValueError(f"there is no range {range_id}")
        if changes.get("test_id", now["test_id"]) != now["test_id"]:
            raise ValueError("a range can't change its test")
        if now["source"] == "source":
            if changes.get("parent_range_id") is not None:
                raise ValueError("a source range has no parent")
            changes = {k: v for k, v in changes.items() if k not in ("start_ms", "end_ms")}
        keep_null = {"parent_range_id"} & set(changes)
        changes = {k: v for k, v in changes.items() if v is not None or k in keep_null}
        row = now | changes
        if row["end_ms"] <= row["start_ms"]:
            raise ValueError("a range must end after its start")
        rows = self.read("ranges")
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        own = F.col("range_id") == range_id
        for column, value in (changes | {"updated_at": datetime.now(timezone.utc)}).items():
            rows = rows.withColumn(column, F.when(own, F.lit(value).cast(kinds[column])).otherwise(F.col(column)))
        rows = rows.withColumnRenamed("test_id", "test_run_id")
        if now["source"] != "source":
            sources = rows.where("source = 'source'").select("range_id", "test_run_id", "start_ms", "end_ms")
            rows = ops.adopt(rows.where(own), sources).unionByName(rows.where(~own))
            fault = ops.with_parents_checked(rows.where(own), rows).first()["fault"]
            if fault:
                raise ValueError(f"range {row['name']!r}: {fault}")
        self.write("ranges", rows.withColumnRenamed("test_run_id", "test_id"))
        if parameters is not None:
            self._put_range_parameters(range_id, parameters)
        return self.get_range(range_id)

    @changes
    def delete_range(self, range_id: int) -> None:
        """Deletes a range; source ranges stay, and children go to their test's source range."""
        now = self.get_range(range_id)
        if now is None or now["source"] == "source":
            raise ValueError("a source range can't be deleted" if now else f"there is no range {range_id}")
        rows = ops.delete_range(self.read("ranges").withColumnRenamed("test_id", "test_run_id"), range_id)
        self.write("ranges", rows.withColumnRenamed("test_run_id", "test_id"))
        self.write("range_parameters", self.read("range_parameters").where(F.col("range_id") != range_id))

    # --- rules ---

    @changes
    def create_rule(self, name: str, kind: str, channel_name: str, config: str | dict, default_label: str | None = None, default_color: str | None = None) -> dict:
        if kind not in ("threshold", "edge", "formula"):
            raise ValueError(f"unknown rule kind {kind!r}")
        text = json.dumps(parse_config(config))
        row = self.spark.createDataFrame([(name, kind, channel_name, text, default_label, default_color)], "name string, kind string, channel_name string, config string, default_label string, default_color string")
        made = self.append("range_rules", row, "rule_id").first()
        return self.get_rule(made["rule_id"])

    def list_rules(self) -> DataFrame:
        return self.read("range_rules").orderBy("name", "rule_id")

    def get_rule(self, rule_id: int) -> dict | None:
        found = self.read("range_rules").where(F.col("rule_id") == rule_id).first()
        return found.asDict() if found else None

    @changes
    def apply_rule(self, rule_id: int, series: DataFrame) -> DataFrame:
        """Ranges by a stored rule in all runs of the series, added to the catalog."""
        rule = self.get_rule(rule_id)
        if rule is None:
            raise ValueError(f"there is no rule {rule_id}")
        found = ops.named(ops.detect(series, rule), rule["default_label"] or rule["name"])
        values = {"label": rule["default_label"], "color": rule["default_color"], "source": "rule"}
        new = found.select(F.col("test_run_id").alias("test_id"), "name", "start_ms", "end_ms", F.lit(rule_id).cast("long").alias("rule_id"), *[F.lit(v).cast("string").alias(k) for k, v in values.items()])
        return self.create_ranges(new)

    @changes
    def apply_definitions(self, definitions: list[dict], series: DataFrame) -> DataFrame:
        """Ranges of definition trees, added to the catalog level by level, so that children get their parents' ids."""
        found = durable(ops.apply_definitions(series, definitions))
        made = self.spark.createDataFrame([], "test_id long, definition string, node string, range_id long")
        while True:
            waiting = found.join(made.select("definition", "node", F.col("test_id").alias("test_run_id")), ["definition", "node", "test_run_id"], "left_anti")
            ids = made.select("definition", F.col("node").alias("parent_node"), F.col("test_id").alias("test_run_id"), F.col("range_id").alias("parent_range_id"))
            ready = waiting.join(ids, ["definition", "parent_node", "test_run_id"], "left").where("parent_node is null or parent_range_id is not null")
            ready = durable(ready)
            if ready.isEmpty():
                return made
            new = ready.select(F.col("test_run_id").alias("test_id"), "name", "label", "color", "start_ms", "end_ms", "parent_range_id", F.lit("rule").alias("source"), "definition", "node")
            added = self.create_ranges(new)
            made = durable(made.unionByName(added.select("test_id", "definition", "node", "range_id")))

    # --- results ---

    @changes
    def put_results(self, rows: DataFrame) -> None:
        self.write("results", upsert_results(self.read("results"), rows, self._change.ids.get("results", 0)))
        self._gave("results", self.read("results"), "result_id")

    def list_results(self, test_id: int | None = None, analysis: str | None = None) -> DataFrame:
        return filter_results(self.read("results"), test_id, analysis).orderBy("test_id", "analysis_name", "key", "result_id")


def with_ids(rows: DataFrame, old: DataFrame, column: str, above: int = 0) -> DataFrame:
    """rows, numbered in order behind the greatest id of old, and above the given one. Each range of rows is numbered on its own, behind the
    counts of those before it."""
    top = max(above, old.agg(F.coalesce(F.max(column), F.lit(0))).first()[0])
    order = [c for c in rows.columns if c != column and rows.schema[c].dataType.simpleString() in ("string", "bigint", "double")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    # the number of the range in the upper bits, the place in it in the lower 33; kept, so that counts and rows are of the same ranges
    dealt = durable(dealt.drop(column).withColumn("_at", F.monotonically_increasing_id()))
    ranges, before = [], top + 1
    for r in dealt.groupBy(F.shiftright("_at", 33).alias("_range")).count().orderBy("_range").collect():  # a row for each range
        ranges.append((r["_range"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(ranges, "_range long, _start long")
    placed = dealt.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(starts), "_range")
    return placed.withColumn(column, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_range", "_at", "_start")


def place_ranges(new: DataFrame, old: DataFrame, above: int = 0) -> DataFrame:
    """new(test_id, name, start_ms, end_ms, ...) with ids behind those of old, parents, and a column fault, null where a range can be added."""
    for column, kind in (("parent_range_id", "long"), ("source", "string"), ("created_at", "timestamp")):
        if column not in new.columns:
            new = new.withColumn(column, F.lit(None).cast(kind))
    new = new.withColumn("source", F.coalesce("source", F.lit("user"))).withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
    new = with_ids(new, old, "range_id", above).withColumnRenamed("test_id", "test_run_id")
    old = old.withColumnRenamed("test_id", "test_run_id").select("range_id", "test_run_id", "parent_range_id", "start_ms", "end_ms", "source")
    both = old.unionByName(new.select(*old.columns))
    sources = both.where("source = 'source'")
    several = sources.groupBy("test_run_id").agg(F.count("*").alias("_sources")).where("_sources > 1").select("test_run_id", F.lit(True).alias("_several"))
    first = sources.groupBy("test_run_id").agg(F.min_by(F.struct("range_id", "start_ms", "end_ms"), "range_id").alias("s")).select("s.range_id", "test_run_id", "s.start_ms", "s.end_ms")
    new = new.withColumn("parent_range_id", F.when(F.col("source") != "source", F.col("parent_range_id")))
    new = ops.adopt(new.where("source <> 'source'"), first).unionByName(new.where("source = 'source'"))
    checked = ops.with_parents_checked(new, both).join(several, "test_run_id", "left")
    second = F.col("_several") & (F.col("source") == "source")
    backward = F.col("end_ms") < F.col("start_ms")
    fault = F.when(second, "a second source range").when(backward, "ends before its start").otherwise(F.col("fault"))
    return checked.withColumn("fault", fault).drop("_several").withColumnRenamed("test_run_id", "test_id")


def promote_legacy(ranges: DataFrame) -> DataFrame:
    """Ranges in which the root 1 of users is the source range of a test without one, and parent of the roots inside it."""
    have = ranges.where("source = 'source'").select("test_id").distinct().withColumn("_has", F.lit(True))
    rows = ranges.join(have, "test_id", "left")
    legacy = F.col("_has").isNull() & (F.col("range_id") == 1) & F.col("parent_range_id").isNull() & (F.col("source") == "user")
    rows = rows.withColumn("_legacy", legacy).withColumn("source", F.when(legacy, "source").otherwise(F.col("source")))
    made = rows.where("_legacy").select("range_id", F.col("test_id").alias("test_run_id"), "start_ms", "end_ms")
    return ops.adopt(rows.select(*ranges.columns).withColumnRenamed("test_id", "test_run_id"), made).withColumnRenamed("test_run_id", "test_id").select(*ranges.columns)


def with_range_parameters(ranges: DataFrame, parameters: DataFrame) -> DataFrame:
    """ranges with a list of their parameters by key, empty where there are none."""
    own = F.array_sort(F.collect_list(F.struct("key", "value_text", "value_num"))).alias("parameters")
    rows = ranges.join(parameters.groupBy("range_id").agg(own), "range_id", "left")
    kind = rows.schema["parameters"].dataType
    return rows.withColumn("parameters", F.coalesce("parameters", F.array().cast(kind))).select(*ranges.columns, "parameters")


def with_icons(tests: DataFrame, parameters: DataFrame) -> DataFrame:
    """tests with the icon that their parameters name, null where they name none."""
    icons = parameters.where(F.col("key") == ICON).groupBy("test_id").agg(F.min("value_text").alias("icon"))
    return tests.join(icons, "test_id", "left")


def channel_entries(channels: DataFrame, test_id: int, names: list[str] | None = None) -> DataFrame:
    own = channels.where(F.col("test_id") == test_id)
    return (own if names is None else own.where(F.col("channel_name").isin(list(names)))).orderBy("channel_name")


def channels_of(tests: DataFrame, channels: DataFrame, limit: int | None = None) -> DataFrame:
    """Each channel name of the tests once, by name."""
    rows = channels.join(tests.select("test_id"), "test_id", "left_semi").select("channel_name").distinct().orderBy("channel_name")
    return rows.limit(max(1, min(limit, 5_000_000))) if limit is not None else rows


def table_counts(tests: DataFrame, channels: DataFrame) -> DataFrame:
    """One row: how many tests and channels there are."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1))
    return n(tests, "tests").join(n(channels, "channels"), "_one").drop("_one")


def tables_with_columns(columns: DataFrame, wanted: list[str]) -> DataFrame:
    """Tables of columns(table_name, column_name) that have all the wanted ones, by name."""
    own = columns.where(F.col("column_name").isin(wanted)).groupBy("table_name").agg(F.countDistinct("column_name").alias("_n"))
    return own.where(F.col("_n") == len(set(wanted))).select("table_name").orderBy("table_name")


def latest_tests(tests: DataFrame, limit: int | None = None) -> DataFrame:
    """By start (or creation) time, newest first, then by id; all of them without a limit."""
    rows = tests.orderBy(F.coalesce("start_time", "created_at").desc_nulls_last(), F.col("test_id").desc())
    return rows if limit is None else rows.limit(max(1, limit))


def upsert_results(old: DataFrame, new: DataFrame, above: int = 0) -> DataFrame:
    """old with the values of new for equal test, range (null equals null), analysis and key; others are added with new ids."""
    key = ["test_id", "range_id", "analysis_name", "key"]
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key]
    kept = old.alias("o").join(new.alias("n"), same("o", "n"), "left_anti")
    ids = old.select(*key, "result_id")
    met = new.drop("result_id").alias("n").join(ids.alias("o"), same("n", "o"), "left").select("n.*", "o.result_id")
    known = met.where("result_id is not null")
    added = with_ids(met.where("result_id is null"), old, "result_id", above)
    return kept.unionByName(known.select(*old.columns)).unionByName(added.select(*old.columns))


def filter_results(results: DataFrame, test_id: int | None = None, analysis: str | None = None) -> DataFrame:
    if test_id is not None:
        results = results.where(F.col("test_id") == test_id)
    if analysis:
        results = results.where(F.col("analysis_name") == analysis)
    return results


def parameter_map(parameters: DataFrame) -> DataFrame:
    """A map of each test's parameters; numbers go before texts."""
    value = F.coalesce(F.col("value_num").cast("string"), F.col("value_text"))
    return parameters.groupBy("test_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", value)))).alias("parameters"))


def clean_tags(tags: Column) -> Column:
    """Trimmed tags without empty ones and without repeats, whatever their case; the first form stays."""
    trimmed = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
    return F.filter(trimmed, lambda t, i: F.array_position(F.transform(trimmed, lambda x: F.lower(x)), F.lower(t)) == i + 1)


def tags_json(tags: Column) -> Column:
    """Cleaned tags as a JSON list, null where there are none."""
    cleaned = clean_tags(tags)
    return F.when(F.size(cleaned) > 0, F.to_json(cleaned))


def tags_from_json(text: Column) -> Column:
    """Cleaned tags of a JSON list; anything else has none."""
    return F.coalesce(clean_tags(F.from_json(text, "array<string>")), F.array().cast("array<string>"))


def artifact_id(kind: Column, path: Column) -> Column:
    return F.substring(F.sha2(F.concat(kind, F.lit(":"), path), 256), 1, 16)


def test_id(artifact: Column) -> Column:
    """The first 48 bits of an artifact id."""
    return F.conv(F.substring(artifact, 1, 12), 16, 10).cast("long")
