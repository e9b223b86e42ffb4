"""Small reads of files by the driver, through the file systems that Spark knows: schemas and footers, never data."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import SparkSession


class HadoopFile(io.RawIOBase):
    """A file of any store that Spark reads, open for reading at any place."""

    _stream = None

    def __init__(self, spark: SparkSession, path: str):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.size, self._stream, self._at = fs.getFileStatus(target).getLen(), fs.open(target), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = offset + (0, self._at, self.size)[whence]
        return self._at

    def tell(self) -> int:
        return self._at

    def readinto(self, out) -> int:
        self._stream.seek(min(self._at, self.size))
        found = bytes(self._stream.readNBytes(len(out)))
        out[: len(found)] = found
        self._at += len(found)
        return len(found)

    def close(self) -> None:
        if not self.closed and self._stream is not None:
            self._stream.close()
        super().close()


def arrow_schema(spark: SparkSession, path: str, kind: str) -> pa.Schema | None:
    """The Arrow schema, with its fields' metadata, of a Parquet or Arrow file; None where there is none to be read."""
    with HadoopFile(spark, path) as raw, pa.PythonFile(raw, "r") as file:
        try:
            if kind == "parquet":
                from pyarrow import parquet

                return parquet.read_schema(file)
            magic = file.read(6)
            file.seek(0)
            if magic[:4] == b"FEA1":
                return None
            return (pa.ipc.open_file if magic == b"ARROW1" else pa.ipc.open_stream)(file).schema
        except pa.ArrowException:
            return None


def first_file(spark: SparkSession, path: str) -> str:
    """The path itself, or the first data file of a folder of them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(target).isDirectory():
        return path
    names = sorted(s.getPath().toString() for s in fs.listStatus(target) if not s.getPath().getName().startswith(("_", ".")))
    return first_file(spark, names[0]) if names else path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store, in one form whatever form it is given in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toUri().getPath()


def first_line(spark: SparkSession, path: str) -> str:
    with HadoopFile(spark, path) as raw, io.BufferedReader(raw) as file:
        return file.readline().decode("utf-8", "replace").lstrip("\ufeff").rstrip("\r\n")
