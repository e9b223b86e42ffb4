"""A stream of samples into the lake, with bucket sums beside it.

Each micro-batch is written by foreachBatch under its number. The logs of the lake and of the sums know which numbers they have, so a batch that
is run again after a failure, wherever that came, adds nothing twice. Sums are partial: late rows of any batch add to their bucket, however old.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog.log import CommitLog
from ..schema import SERIES_COLUMNS
from ..sinks.lake import ATTEMPTS, write_series

SUMS = "test_run_id long, test_run_code string, channel_name string, unit string, bucket_ms double, total double, n long"
BY = ["test_run_id", "test_run_code", "channel_name", "unit", "bucket_ms"]
#: Folders of sums before they are put together.
MOST_FOLDERS = 32


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that come into a folder, in SERIES columns."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def add_sums(samples: DataFrame, path: str, bucket_ms: float, batch: tuple[str, int] | None = None) -> bool:
    """Adds the samples' sums and counts of each bucket; False if the batch has been added before."""
    log = CommitLog(samples.sparkSession, path)
    start = F.floor(F.col("x_ms") / bucket_ms) * F.lit(float(bucket_ms))
    sums = samples.where(F.col("y").isNotNull()).withColumn("bucket_ms", start).groupBy(*BY).agg(F.sum("y").alias("total"), F.count("*").alias("n"))
    folder = f"sums/{uuid.uuid4().hex}"
    written = False
    for _ in range(ATTEMPTS):
        version, content = log.latest()
        batches, folders = content.get("batches", {}), content.get("folders", [])
        if batch and batches.get(batch[0], -1) >= batch[1]:
            break
        if not written:
            sums.write.parquet(f"{log.root}/{folder}")
            written = True
        merged = None
        if len(folders) >= MOST_FOLDERS:
            merged = f"sums/{uuid.uuid4().hex}"
            _summed(log, folders).write.parquet(f"{log.root}/{merged}")
        new = {"folders": [*([merged] if merged else folders), folder], "batches": batches | ({batch[0]: batch[1]} if batch else {})}
        if log.commit(version + 1, new):
            return True
        if merged:
            log.delete(f"{log.root}/{merged}")
    else:
        raise RuntimeError(f"{path}: {ATTEMPTS} attempts were overtaken")
    if written:
        log.delete(f"{log.root}/{folder}")
    return False


def _summed(log: CommitLog, folders: list[str]) -> DataFrame:
    rows = log.spark.read.schema(SUMS).parquet(*[f"{log.root}/{f}" for f in folders]) if folders else log.spark.createDataFrame([], SUMS)
    return rows.groupBy(*BY).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def overview(spark: SparkSession, path: str) -> DataFrame:
    """The means of the buckets so far, as series, with the number of samples."""
    log = CommitLog(spark, path)
    rows = _summed(log, log.latest()[1].get("folders", []))
    return rows.withColumns({"x_ms": F.col("bucket_ms"), "y": F.col("total") / F.col("n")}).select(*SERIES_COLUMNS, "n")


def stream_into_lake(samples: DataFrame, lake: str, sums: str, checkpoint: str, name: str = "stream", bucket_ms: float = 3_600_000.0, available_now: bool = True) -> StreamingQuery:
    """Starts the stream: samples in SERIES columns are added to the lake and to the sums.

    With available_now it ends when it has what there is; started again with the same checkpoint and name it goes on behind that.
    """

    def each(rows: DataFrame, number: int) -> None:
        rows = rows.select(*SERIES_COLUMNS).persist()
        try:
            write_series(rows, lake, replace=False, batch=(name, number))
            add_sums(rows, sums, bucket_ms, (name, number))
        finally:
            rows.unpersist()

    writer = samples.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
