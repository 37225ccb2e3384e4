"""Text lines with dense numbers, and their lookup."""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import RANGE_BYTES, dealt, each_range, listed, opened

NO_FILE, NO_LINE = "ERROR: Could not open file", "ERROR: Line not found"
_CHUNK = 1 << 20
_COUNTS = pa.schema([("file_no", pa.int32()), ("begin", pa.int64()), ("n", pa.int64())])
_LINES = pa.schema([("file_no", pa.int32()), ("begin", pa.int64()), ("no", pa.int64()), ("text", pa.string())])


def _count(r: dict) -> Iterator[pa.RecordBatch]:
    """Lines that begin in a range: at its first byte or after a newline."""
    n = int(r["begin"] == 0 and r["size"] > 0)
    with opened(r["path"]) as f:
        f.seek(max(r["begin"] - 1, 0))
        # a line begins at b if byte b - 1 is a newline, for b in the range and before the file's end
        left = r["end"] - 1 - max(r["begin"] - 1, 0)
        while left > 0 and (data := f.read(min(_CHUNK, left))):
            n += data.count(b"\n")
            left -= len(data)
    yield pa.RecordBatch.from_arrays([pa.array([r["file_no"]], pa.int32()), pa.array([r["begin"]]), pa.array([n])], schema=_COUNTS)


def _read(r: dict) -> Iterator[pa.RecordBatch]:
    no, out = 0, []

    def batch() -> pa.RecordBatch:
        n = len(out)
        return pa.RecordBatch.from_arrays([pa.array([r["file_no"]] * n, pa.int32()), pa.array([r["begin"]] * n, pa.int64()), pa.array(range(no - n, no), pa.int64()), pa.array(out, pa.string())], schema=_LINES)

    with opened(r["path"]) as f:
        f.seek(max(r["begin"] - 1, 0))
        stream = io.BufferedReader(f, _CHUNK)
        at = max(r["begin"] - 1, 0)
        if r["begin"]:
            at += len(stream.readline())  # the rest of a line that began before; just a newline if none did
        while at < r["end"] and (line := stream.readline()):
            at += len(line)
            out.append(line.rstrip(b"\n").decode("utf-8", "replace"))
            no += 1
            if len(out) == 4096:
                yield batch()
                out = []
    if out:
        yield batch()


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, text): lines numbered from 0 without gaps, over a folder's files by name.

    One pass counts the lines of each byte range, one number a range; a second one reads them.
    """
    ranges = dealt(spark, listed(spark, path), 1, range_bytes)
    counts = sorted(map(tuple, ranges.mapInArrow(lambda b: each_range(b, _count), "file_no int, begin long, n long").collect()))
    starts = [0, *accumulate(n for *_, n in counts)]
    first = spark.createDataFrame([(f, b, s) for (f, b, _), s in zip(counts, starts, strict=False)], "file_no int, begin long, first long")
    rows = ranges.mapInArrow(lambda b: each_range(b, _read), "file_no int, begin long, no long, text string")
    return rows.join(F.broadcast(first), ["file_no", "begin"]).select((F.col("first") + F.col("no")).alias("id"), "text")


def lookup(hits: DataFrame, lines: DataFrame | None, id_col: str = "id") -> DataFrame:
    """``hits`` with the text of line ``id``; a text that says so if there is no such line, or no file (None)."""
    if lines is None:
        return hits.withColumn("text", F.lit(NO_FILE))
    found = lines.select(F.col("id").alias("__line"), F.col("text").alias("__text"))
    return hits.join(found, hits[id_col] == F.col("__line"), "left").withColumn("text", F.coalesce("__text", F.lit(NO_LINE))).drop("__line", "__text")


def write_text(rows: DataFrame, path: str, order: str, text_col: str = "text") -> None:
    """The texts in a folder of files, in order and newlines as spaces, so that ``read_lines`` numbers them alike; few rows make one file."""
    rows.orderBy(order).select(F.translate(text_col, "\n", " ").alias("value")).write.mode("overwrite").text(path)
