"""The lake: series as Parquet in parts that are clustered by test, channel and time, under a commit log.

A write is one part, whatever number of tests it has: ranges of (test, channel, time) of about equal size are its files, so short tests share
files and a long channel is many. Row groups are sorted, so their statistics prune tests, channels and times; the log has the least and
greatest test of a part, which prunes parts. A write that replaces series notes which write theirs is; rows of other writes are passed over,
and go when small parts are merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog.log import CommitLog
from ..operators.series import time_window
from ..schema import SERIES_COLUMNS
from ..session import durable

#: Rows that a task of a write sorts (about), rows of a file at most, and bytes of a row group.
ROWS_PER_TASK, ROWS_PER_FILE, ROW_GROUP_BYTES = 1 << 20, 20_000_000, 16 << 20
#: Parts of fewer rows are small; so many of them are merged by the next write.
SMALL_ROWS, MOST_SMALL = 20_000_000, 32
ATTEMPTS = 50
ROWS = "test_id long, channel_name string, test_run_code string, unit string, x_ms double, y double, write_id long"
OWNERS = "test_id long, channel_name string, owner long"


def _state(log: CommitLog) -> tuple[int, dict]:
    """The newest version: its parts, the folder of the owners of replaced series (or none), and the batches that streams have written."""
    version, content = log.latest()
    return version, {"parts": [], "owners": None, "batches": {}} | {k: v for k, v in content.items() if k in ("parts", "owners", "batches")}


def _commit(log: CommitLog, change: Callable[[dict], dict | None]) -> dict | None:
    """Commits what change makes of the newest state, again and again until this writer wins; None from it is nothing to do."""
    for _ in range(ATTEMPTS):
        version, state = _state(log)
        new = change(state)
        if new is None or log.commit(version + 1, new):
            return new
    raise RuntimeError(f"{log.root}: {ATTEMPTS} attempts were overtaken")


def _write_part(log: CommitLog, rows: DataFrame, write_id: int | None = None) -> dict:
    """Writes rows as a part and says what the log has of it.

    Ranges are as many as the rows need: adaptive execution would merge them by their compressed size, and one task sort more the larger the write.
    """
    folder = f"parts/{uuid.uuid4().hex}"
    columns = [F.lit(write_id).cast("long").alias("write_id") if c == "write_id" and write_id is not None else F.col(c) for c in ("test_id", "channel_name", "test_run_code", "unit", "x_ms", "y", "write_id")]
    order = ["test_id", "channel_name", "x_ms"]
    time = F.timestamp_micros(F.round(F.col("x_ms") * 1000).cast("long")).alias("timestamp_utc")
    tasks = max(1, -(-rows.count() // ROWS_PER_TASK))
    (
        rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(*columns, time)
        .write.option("maxRecordsPerFile", ROWS_PER_FILE).option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{log.root}/{folder}")
    )
    n, low, high = log.spark.read.schema(ROWS).parquet(f"{log.root}/{folder}").agg(F.count("*"), F.min("test_id"), F.max("test_id")).first()
    return {"folder": folder, "rows": n, "low": low, "high": high}


def _rows(log: CommitLog, state: dict, tests: list[int] | None = None) -> DataFrame:
    """The live rows of the parts that may have the tests."""
    parts = [p for p in state["parts"] if p["rows"] and (tests is None or any(p["low"] <= t <= p["high"] for t in tests))]
    if not parts:
        return log.spark.createDataFrame([], ROWS)
    rows = log.spark.read.schema(ROWS).parquet(*[f"{log.root}/{p['folder']}" for p in parts])
    wanted = None if tests is None else F.col("test_id").isin(list(tests))
    rows = rows if wanted is None else rows.where(wanted)
    if not state["owners"]:
        return rows
    owners = _owners(log, state)
    owners = owners if wanted is None else owners.where(wanted)
    # a replaced series has one owner; a test that was deleted owns none of its rows
    met = rows.join(owners, ["test_id", "channel_name"], "left")
    return met.where(F.coalesce(F.col("owner") == F.col("write_id"), F.lit(True))).drop("owner")


def _owners(log: CommitLog, state: dict) -> DataFrame:
    return log.spark.read.schema(OWNERS).parquet(f"{log.root}/{state['owners']}") if state["owners"] else log.spark.createDataFrame([], OWNERS)


def _with_owners(log: CommitLog, state: dict, keys: DataFrame, owner: int) -> dict:
    """The state in which the series of keys(test_id, channel_name) belong to one write; only those that older parts have are noted."""
    held = _rows(log, state | {"owners": None}).join(keys, ["test_id", "channel_name"], "left_semi").select("test_id", "channel_name").distinct()
    new = durable(held.withColumn("owner", F.lit(owner).cast("long")))
    if new.isEmpty():
        return state
    folder = f"owners/{uuid.uuid4().hex}"
    _owners(log, state).join(new, ["test_id", "channel_name"], "left_anti").unionByName(new).coalesce(1).write.parquet(f"{log.root}/{folder}")
    return state | {"owners": folder}


def write_series(series: DataFrame, path: str, replace: bool = True, batch: tuple[str, int] | None = None) -> bool:
    """Writes series as one part. With replace they take the place of what the lake has of the same tests and channels.

    batch names a stream and the number of its batch, which is written once: what has been committed is not written again, and False returned.
    """
    spark = series.sparkSession
    log = CommitLog(spark, path)
    done = lambda state: batch is not None and state["batches"].get(batch[0], -1) >= batch[1]
    if done(_state(log)[1]):
        return False
    write_id = uuid.uuid4().int >> 65  # 63 bits
    part = _write_part(log, series.withColumn("test_id", F.col("test_run_id")), write_id)
    keys = spark.read.schema(ROWS).parquet(f"{log.root}/{part['folder']}").select("test_id", "channel_name").distinct()

    def change(state: dict) -> dict | None:
        if done(state):
            return None
        new = _with_owners(log, state, keys, write_id) if replace and state["parts"] else state
        batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
        return new | {"parts": [*state["parts"], part], "batches": batches}

    committed = _commit(log, change)
    if committed is None:
        log.delete(f"{log.root}/{part['folder']}")
        return False
    if sum(p["rows"] < SMALL_ROWS for p in committed["parts"]) >= MOST_SMALL:
        merge_small(spark, path)
    return True


def delete_tests(spark: SparkSession, path: str, tests: list[int]) -> None:
    """Takes all series of the tests out of the lake."""
    log = CommitLog(spark, path)

    def change(state: dict) -> dict | None:
        held = _rows(log, state, list(tests)).select("test_id", "channel_name").distinct()
        new = _with_owners(log, state, held, 0)
        return None if new is state else new

    _commit(log, change)


def merge_small(spark: SparkSession, path: str) -> None:
    """Merges the small parts into one, without rows that have been replaced. Folders that no version has are deleted by expire()."""
    log = CommitLog(spark, path)

    def change(state: dict) -> dict | None:
        small = [p for p in state["parts"] if p["rows"] < SMALL_ROWS]
        if len(small) < 2:
            return None
        merged = _write_part(log, _rows(log, state | {"parts": small}))
        return state | {"parts": [p for p in state["parts"] if p not in small] + [merged]}

    _commit(log, change)


def expire(spark: SparkSession, path: str, keep: int = 3) -> int:
    """Deletes folders that none of the last `keep` versions has but an older one had, and returns how many; readers that began earlier lose them."""
    log = CommitLog(spark, path)

    def folders(version: int) -> set[str]:
        content = log.read(version) or {}
        return {p["folder"] for p in content.get("parts", [])} | ({content["owners"]} if content.get("owners") else set())

    versions = log.versions()
    live = set().union(*map(folders, versions[-keep:]))
    gone = set().union(*map(folders, versions[:-keep])) - live
    for folder in gone:
        log.delete(f"{log.root}/{folder}")
    return len(gone)


def read_series(spark: SparkSession, path: str, tests: list[int] | None = None, channels: list[str] | None = None, start_ms: float | None = None, end_ms: float | None = None) -> DataFrame:
    """Series of the lake. Tests prune parts; tests, channels and times reach the Parquet reader."""
    log = CommitLog(spark, path)
    rows = _rows(log, _state(log)[1], None if tests is None else [int(t) for t in tests])
    if channels is not None:
        rows = rows.where(F.col("channel_name").isin(list(channels)))
    return time_window(rows, start_ms, end_ms).withColumnRenamed("test_id", "test_run_id").select(*SERIES_COLUMNS)
