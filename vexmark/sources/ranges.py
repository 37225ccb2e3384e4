"""Files read by byte ranges on the executors.

The driver lists files and their sizes and deals them into ranges; each range is a row, and a ``mapInArrow`` opens its file
and reads its part only. A file of any size is thus spread over as many tasks as it has ranges, and a lost executor's ranges
are read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import Code, EngineError
from ..files import Files

RANGE_BYTES = 64 << 20


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(file, bytes); kNotFound if there is nothing."""
    files = Files(spark)
    if not files.exists(path):
        raise EngineError(Code.NOT_FOUND, path)
    return files.files(path)


def uri(path: str) -> str:
    """A path as a URI with as many slashes as pyarrow wants."""
    if "://" in path:
        return path
    return f"file://{path.removeprefix('file:')}"


def opened(path: str) -> BinaryIO:
    """A file by its URI, on an executor."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(uri(path))
    return system.open_input_file(at)


def dealt(spark: SparkSession, files: list[tuple[str, int]], unit: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file_no, path, begin, end, size): ranges that are multiples of ``unit``, one to a partition."""
    step = max(1, range_bytes // unit) * unit
    rows = [(k, p, b, min(b + step, n), n) for k, (p, n) in enumerate(files) for b in range(0, max(n, 1), step)]
    ranges = spark.createDataFrame(rows or [(0, "", 0, 0, 0)], "file_no int, path string, begin long, end long, size long")
    return ranges.where("path <> ''").repartition(max(1, len(rows)))


def each_range(batches: Iterator[pa.RecordBatch], read: Callable[[dict], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            yield from read(row)
