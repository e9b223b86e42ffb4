"""The relational star: readings of channels in test runs, from JDBC or any three DataFrames."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SERIES_COLUMNS

_identifier = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def safe_identifier(name: str) -> str:
    if not _identifier.match(name or ""):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def jdbc_tables(spark: SparkSession, url: str, properties: dict, partitions: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sensor_readings, channels, test_runs); filters reach the database, `partitions` are predicates that split the readings."""
    readings = spark.read.jdbc(url, "sensor_readings", predicates=partitions, properties=properties) if partitions else spark.read.jdbc(url, "sensor_readings", properties=properties)
    return readings, spark.read.jdbc(url, "channels", properties=properties), spark.read.jdbc(url, "test_runs", properties=properties)


@dataclass(frozen=True)
class Dialect:
    """How a database says the milliseconds since the epoch of a time, and a time literal."""

    epoch_ms: str
    literal: str = "TIMESTAMP '{}'"


DIALECTS = {
    "postgresql": Dialect("(EXTRACT(EPOCH FROM {0}) * 1000)"),
    "derby": Dialect("({{fn TIMESTAMPDIFF(SQL_TSI_SECOND, TIMESTAMP('1970-01-01 00:00:00'), {0})}} * 1000.0)", "TIMESTAMP('{}')"),
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _at(dialect: Dialect, ms: float) -> str:
    return dialect.literal.format(datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f"))


def jdbc_span(spark: SparkSession, url: str, properties: dict, channels: list[str] | None = None, tests: list[int] | None = None) -> tuple[float, float] | None:
    """First and last time of the readings, by the database."""
    dialect = DIALECTS[url.split(":")[1]]
    ms = dialect.epoch_ms.format("r.time")
    sql = f"SELECT MIN({ms}) AS low_ms, MAX({ms}) AS high_ms FROM sensor_readings r JOIN channels c ON r.channel_id = c.id{_where(channels, tests)}"
    low, high = (None if v is None else float(v) for v in spark.read.jdbc(url, f"({sql}) q", properties=properties).first())
    return None if low is None else (low, high)


def _where(channels: list[str] | None, tests: list[int] | None, *more: str) -> str:
    parts = [*more]
    if channels is not None:
        parts.append(f"c.channel_name IN ({', '.join(map(_text, channels)) or 'NULL'})")
    if tests is not None:
        parts.append(f"r.test_run_id IN ({', '.join(str(int(t)) for t in tests) or 'NULL'})")
    return f" WHERE {' AND '.join(parts)}" if parts else ""


def jdbc_buckets(spark: SparkSession, url: str, properties: dict, bucket_ms: float, span: tuple[float, float], channels: list[str] | None = None, tests: list[int] | None = None, slices: int = 8) -> DataFrame:
    """Bucket averages of the star as series, made by the database: Spark reads buckets, not readings.

    The span is cut at bucket edges into slices, each a partition with its own query over its own times, so that buckets are whole and an index on time is of
    use. Means are those of bucket_average() of star_series().
    """
    dialect = DIALECTS[url.split(":")[1]]
    ms = dialect.epoch_ms.format("r.time")
    low, high = math.floor(span[0] / bucket_ms), math.floor(span[1] / bucket_ms) + 1
    step = max(1, math.ceil((high - low) / max(1, slices)))
    out = None
    for first in range(low, high, step):
        bounds = [f"r.time >= {_at(dialect, first * bucket_ms)}", f"r.time < {_at(dialect, min(first + step, high) * bucket_ms)}"]
        inner = (
            f"SELECT r.test_run_id, t.run_code, c.channel_name, c.unit, FLOOR({ms} / {float(bucket_ms)!r}) AS bucket, r.value FROM sensor_readings r "
            f"JOIN channels c ON r.channel_id = c.id JOIN test_runs t ON r.test_run_id = t.id{_where(channels, tests, *bounds)}"
        )
        sql = f"(SELECT test_run_id, run_code, channel_name, unit, bucket, AVG(value) AS y FROM ({inner}) b GROUP BY test_run_id, run_code, channel_name, unit, bucket) q"
        part = spark.read.jdbc(url, sql, properties=properties)
        part = part.toDF(*[c.lower() for c in part.columns])
        out = part if out is None else out.unionByName(part)
    kinds = {"test_run_id": "long", "run_code": "string", "channel_name": "string", "unit": "string", "bucket": "double", "y": "double"}
    rows = out.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    return rows.withColumnRenamed("run_code", "test_run_code").withColumn("x_ms", F.col("bucket") * F.lit(float(bucket_ms))).select(*SERIES_COLUMNS)


def star_series(readings: DataFrame, channels: DataFrame, runs: DataFrame) -> DataFrame:
    """readings(test_run_id, channel_id, time, value) with channels(id, channel_name, unit) and runs(id, run_code) as series.

    Inner joins without hints: Spark broadcasts a dimension when it is small and otherwise splits skewed keys.
    """
    c = channels.select(F.col("id").alias("channel_id"), "channel_name", "unit")
    r = runs.select(F.col("id").alias("test_run_id"), F.col("run_code").alias("test_run_code"))
    joined = readings.join(c, "channel_id").join(r, "test_run_id")
    return joined.withColumn("x_ms", F.unix_micros(F.col("time").cast("timestamp")) / 1000).withColumn("y", F.col("value").cast("double")).select(*SERIES_COLUMNS)


def tests_with_start(runs: DataFrame, readings: DataFrame) -> DataFrame:
    """All runs with the time of their first reading, null where there is none."""
    first = readings.groupBy("test_run_id").agg(F.min("time").alias("t0"))
    return runs.join(first.withColumnRenamed("test_run_id", "id"), "id", "left")


def overlay(targets: dict[str, DataFrame]) -> DataFrame:
    """Series of several databases under each other, with their label as source."""
    frames = [df.withColumn("source", F.lit(label)) for label, df in targets.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def overlay_targets(source: str, databases: dict[str, str], overlay_mode: bool = False, database: str | None = None) -> list[tuple[str, str]]:
    """(label, database) to read: a named database wins; both and overlay fan out to all."""
    if database:
        return [(source or database, database)]
    if overlay_mode or source in ("both", "overlay"):
        return list(databases.items())
    if source not in databases:
        raise ValueError(f"unknown source {source!r}")
    return [(source, databases[source])]


def first_channels(channels: DataFrame, ordered_tests: DataFrame, limit: int | None = None) -> DataFrame:
    """Each channel name once, from the first test that has it in the order of ordered_tests(test_id, position)."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("channel_name").orderBy("position", "test_id")
    rows = channels.join(ordered_tests, "test_id").withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
    return rows.orderBy("position", "channel_name").limit(limit) if limit else rows
