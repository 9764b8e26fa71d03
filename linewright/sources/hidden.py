"""Lines of files that Spark's own sources pass over, as a Python data source with byte ranges as partitions.

Spark's file sources never read a file whose name starts with a dot or an underscore. This one reads just those, by
pyarrow's file systems: local and mounted paths, and stores that pyarrow can open where the executors run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "value binary, uri string, block_start bigint"
_READ_BYTES = 1 << 20
_BATCH_LINES = 4096
_BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def open_store(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a Hadoop URI and the path in it."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return arrow_fs.LocalFileSystem(), unquote(parts.path)
    scheme = {"s3a": "s3", "s3n": "s3"}.get(parts.scheme, parts.scheme)
    try:
        return arrow_fs.FileSystem.from_uri(f"{scheme}://{parts.netloc}{unquote(parts.path)}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as error:
        raise ValueError(f"{uri} has a hidden name and lies in a store that only Spark's sources open; skip it or rename it") from error


def lines_from(stream, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in bytes [start, end) of a seekable stream, without their ends (\\n, \\r or \\r\\n).

    A line begins at byte 0 and after each line end, so every line begins in one range. The last line may lack an end.
    """
    stream.seek(max(start - 1, 0))
    held, at, done = b"", max(start - 1, 0), False
    # Before the range stands its last foreign byte, or nothing.
    skipping = start > 0

    def cut(position: int) -> int:
        """Bytes of the line end at a place of `held`, which is followed by a byte or the end of the file."""
        return 2 if held[position : position + 2] == b"\r\n" else 1

    place = 0
    while True:
        found = [i for i in (held.find(b"\n", place), held.find(b"\r", place)) if i >= 0]
        # A carriage return at the very end may be half of a line end.
        if not found or (held[min(found)] == 13 and min(found) == len(held) - 1 and not done):
            if done:
                break
            place = min(found) if found else len(held)
            more = stream.read(_READ_BYTES)
            done = not more
            held += more
            continue
        to = min(found)
        after = to + cut(to)
        if skipping:
            skipping = False
        else:
            if at >= end:
                return
            yield held[:to]
        at += after
        held, place = held[after:], 0
        if at >= end:
            return
    if held and not skipping and at < end:
        yield held


class _Range(InputPartition):
    def __init__(self, uri: str, start: int, end: int) -> None:
        self.uri, self.start, self.end = uri, start, end


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.files = json.loads(options["files"])
        self.bytes = int(options["rangebytes"] if "rangebytes" in options else options["rangeBytes"])

    def partitions(self) -> list[InputPartition]:
        return [_Range(uri, at, min(at + self.bytes, size)) for uri, size in self.files for at in range(0, size, self.bytes)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, path = open_store(partition.uri)
        held: list[bytes] = []

        def batch() -> pa.RecordBatch:
            n = len(held)
            columns = [pa.array(held, pa.binary()), pa.array([partition.uri] * n, pa.string()), pa.array([partition.start] * n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["value", "uri", "block_start"])

        with store.open_input_file(path) as stream:
            size = 0
            for number, line in enumerate(lines_from(stream, partition.start, partition.end)):
                if not number and not partition.start:
                    line = line.removeprefix(_BYTE_ORDER_MARK)
                held.append(line)
                size += len(line)
                if len(held) >= _BATCH_LINES or size >= _READ_BYTES:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()


class HiddenLines(DataSource):
    """Option `files`: a JSON list of [URI, size]; `rangeBytes`: most bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "linewright_hidden_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def hidden_lines(spark: SparkSession, found: list[tuple[str, int]]) -> DataFrame:
    """(value, uri, block_start) of files given by URI and size, in the form of a text scan with its file splits."""
    spark.dataSource.register(HiddenLines)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    ranges = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)
    lines = spark.read.format(HiddenLines.name()).options(files=json.dumps(found), rangeBytes=str(ranges)).load()
    value: Column = F.col("value").cast("string")
    return lines.select(value.alias("value"), "uri", "block_start")
