"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of a batch of rows that goes to a Python worker: with very long texts it is fewer rows.
BATCH_BYTES, BATCH_SETTING = 64 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. A session that sets no smaller bound for batches of rows to Python gets one."""
    if int(spark.conf.get(BATCH_SETTING, str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many more underscores before it as make it none of df's columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where a cluster names none there is none to guess.

    On one machine (a local master, as in tests) a session without it gets a fresh one.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have stopped already; its folder goes with it
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: later steps survive lost executors without recomputing it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def released(table: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing that is still to be computed reads it."""
    _delete(table.sparkSession, table._stored_at)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. The built-in lower() is the same on pure ASCII and much faster than translate()."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def repeat_rows(df: DataFrame, copies: str) -> DataFrame:
    """Each row as often as its column `copies` says; that column goes."""
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).drop("_copy", copies)
