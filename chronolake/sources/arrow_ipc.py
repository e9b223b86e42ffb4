"""Arrow IPC files, streams and Feather as a Spark data source; the kind is told by the first bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

#: Record batches of a partition.
BATCHES = 16


def _batches(path: str) -> tuple[pa.Schema, Iterator[pa.RecordBatch]]:
    source = pa.memory_map(path)
    magic = source.read(6)
    source.seek(0)
    if magic[:4] == b"FEA1":
        from pyarrow import feather

        table = feather.read_table(path)
        return table.schema, iter(table.to_batches())
    if magic == b"ARROW1":
        file = pa.ipc.open_file(source)
        return file.schema, (file.get_batch(i) for i in range(file.num_record_batches))
    stream = pa.ipc.open_stream(source)
    return stream.schema, iter(stream)


def _pieces(path: str) -> list[tuple[str, int, int | None]]:
    """(path, first, end) of the stretches of record batches of a file, told by its footer; streams and Feather are one piece."""
    with pa.memory_map(path) as source:
        if source.read(6) != b"ARROW1":
            return [(path, 0, None)]
        source.seek(0)
        n = pa.ipc.open_file(source).num_record_batches
    return [(path, at, min(at + BATCHES, n)) for at in range(0, n, BATCHES)]


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(piece) for path in self.paths for piece in _pieces(path)]

    def read(self, partition):
        path, first, end = partition.value
        if end is None:
            yield from _batches(path)[1]
            return
        file = pa.ipc.open_file(pa.memory_map(path))  # only the pages of these batches are touched
        yield from (file.get_batch(i) for i in range(first, end))


class ArrowSource(DataSource):
    """Option path: one file, or several joined by commas; a partition is some record batches of a file. Files lie where executors can open them."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def _paths(self) -> list[str]:
        return [p.removeprefix("file://").removeprefix("file:") for p in self.options["path"].split(",")]

    def schema(self):
        return from_arrow_schema(_batches(self._paths()[0])[0])

    def reader(self, schema):
        return _Reader(self._paths())


def read_arrow(spark: SparkSession, *paths: str) -> DataFrame:
    spark.dataSource.register(ArrowSource)
    return spark.read.format("arrow_ipc").option("path", ",".join(paths)).load()


def field_units(schema: pa.Schema) -> dict[str, str]:
    """Units that fields carry in their metadata."""
    out = {}
    for f in schema:
        for key in (b"unit", b"units"):
            if f.metadata and f.metadata.get(key):
                out.setdefault(f.name, f.metadata[key].decode())
    return out
