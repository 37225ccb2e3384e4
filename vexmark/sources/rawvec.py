"""Raw vector files: headerless float32 matrices, uint64 ids, and fvecs/ivecs, whose rows begin with their own dimension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Code, EngineError
from .ranges import RANGE_BYTES, dealt, each_range, listed, opened, uri

ROWS = 4096


def _vectors(values: np.ndarray, width: int) -> pa.Array:
    flat = pa.array(values.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), flat)


def _matrix(prefix: int, width: int, kind: str):
    """Rows of ``prefix`` bytes and ``width`` four-byte values; a prefix is the row's dimension and must equal ``width``."""
    stride = prefix + 4 * width
    schema = pa.schema([("file_no", pa.int32()), ("row_no", pa.int64()), ("values", pa.list_(pa.float32() if kind == "<f4" else pa.int32()))])

    def read(r: dict) -> Iterator[pa.RecordBatch]:
        with opened(r["path"]) as f:
            f.seek(r["begin"])
            at, end = r["begin"], min(r["end"], r["size"] // stride * stride)  # an incomplete last row isn't one
            while at < end:
                data = np.frombuffer(f.read(min(ROWS * stride, end - at)), np.uint8).reshape(-1, stride)
                if prefix and (data[:, :4].copy().view("<i4")[:, 0] != width).any():
                    raise ValueError(f"{r['path']}: rows differ in dimension")
                values = data[:, prefix:].copy().view(kind)
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["file_no"], np.int32)), pa.array(at // stride + np.arange(n)), _vectors(values, width)], schema=schema)
                at += n * stride

    return lambda batches: each_range(batches, read)


def _scan(spark: SparkSession, path: str, prefix: int, width: int, kind: str, range_bytes: int) -> DataFrame:
    files = listed(spark, path)
    stride = prefix + 4 * width
    base, starts = 0, []
    for _, n in files:
        starts.append(base)
        base += n // stride
    rows = dealt(spark, files, stride, range_bytes).mapInArrow(_matrix(prefix, width, kind), f"file_no int, row_no long, values array<{'float' if kind == '<f4' else 'int'}>")
    first = F.element_at(F.array(*(F.lit(s) for s in starts)), F.col("file_no") + 1) if len(starts) > 1 else F.lit(0)
    return rows.select((F.col("row_no") + first).cast("long").alias("id"), F.col("values"))


def read_f32(spark: SparkSession, path: str, dimensions: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, embedding) of a little-endian float32 matrix; ids count rows from 0, over a folder's files by name.

    Bytes after the last whole row are left out, see ``trailing_bytes``. An empty file has no rows.
    """
    return _scan(spark, path, 0, dimensions, "<f4", range_bytes).withColumnRenamed("values", "embedding")


def trailing_bytes(spark: SparkSession, path: str, dimensions: int) -> int:
    """Bytes after the last whole rows of a raw matrix's files: not 0 if a file was cut short."""
    return sum(n % (4 * dimensions) for _, n in listed(spark, path))


def read_query(spark: SparkSession, path: str, dimensions: int) -> list[float]:
    """The first vector of a raw file; kEof if the file is shorter."""
    (file, size), *_ = listed(spark, path) or [("", 0)]
    if size < 4 * dimensions:
        raise EngineError(Code.EOF, f"{path} has {size} bytes; a vector of {dimensions} takes {4 * dimensions}")
    with opened(file) as f:
        return np.frombuffer(f.read(4 * dimensions), "<f4").tolist()


def _dimension(spark: SparkSession, path: str) -> int | None:
    for file, size in listed(spark, path):
        if size >= 4:
            with opened(file) as f:
                return int(np.frombuffer(f.read(4), "<i4")[0])
    return None


def _prefixed(spark: SparkSession, path: str, kind: str, range_bytes: int) -> DataFrame:
    width = _dimension(spark, path)
    if width is None:
        return spark.createDataFrame([], f"id long, values array<{'float' if kind == '<f4' else 'int'}>")
    if width <= 0:
        raise EngineError(Code.CORRUPTION, f"{path}: dimension {width}")
    return _scan(spark, path, 4, width, kind, range_bytes)


def read_fvecs(spark: SparkSession, path: str, max_vectors: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, embedding). A row whose dimension differs from the first one's fails the query."""
    rows = _prefixed(spark, path, "<f4", range_bytes).withColumnRenamed("values", "embedding")
    return rows if max_vectors is None else rows.where(F.col("id") < max_vectors)


def read_ivecs(spark: SparkSession, path: str, k: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(qid, ids): each query's neighbours, the first ``k`` of them if that is given."""
    rows = _prefixed(spark, path, "<i4", range_bytes).select(F.col("id").alias("qid"), F.col("values").cast("array<long>").alias("ids"))
    return rows if k is None else rows.withColumn("ids", F.slice("ids", 1, k))


def _write_part(folder: str, prefix: bool, kind: str):
    schema = pa.schema([("part", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        system, at = fs.FileSystem.from_uri(folder)
        name = f"{at}/part-{part:06d}.bin"
        beside = f"{at}/_{part:06d}-{uuid.uuid4().hex}"  # a task that is tried again doesn't meet its own remains
        with system.open_output_stream(beside) as f:
            for b in batches:
                col = b.column(0)
                if pa.types.is_list(col.type):
                    values = col.flatten().to_numpy(zero_copy_only=False).astype(kind)
                    width = len(values) // max(1, b.num_rows)
                    rows = values.reshape(b.num_rows, width)
                    if prefix:
                        rows = np.concatenate([np.full((b.num_rows, 1), width, "<i4"), rows.view("<i4")], axis=1)
                    f.write(np.ascontiguousarray(rows).tobytes())
                else:
                    f.write(col.to_numpy().astype(kind).tobytes())
                total += b.num_rows
        system.move(beside, name) if not isinstance(system, fs.LocalFileSystem) else os.replace(beside, name)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total])], schema=schema)

    return run


def _write(rows: DataFrame, folder: str, order: str, value: str, prefix: bool, kind: str) -> int:
    from ..files import Files

    Files(rows.sparkSession).make(folder)
    parts = rows.orderBy(order).select(value).mapInArrow(_write_part(uri(folder), prefix, kind), "part int, n long")
    return parts.agg(F.sum("n")).first()[0] or 0


def write_f32(rows: DataFrame, folder: str, id_col: str = "id", vector_col: str = "embedding") -> int:
    """A folder of raw matrices in the order of ids, so that ``read_f32`` numbers the rows alike; how many rows there are."""
    return _write(rows, folder, id_col, vector_col, False, "<f4")


def write_fvecs(rows: DataFrame, folder: str, id_col: str = "id", vector_col: str = "embedding") -> int:
    return _write(rows, folder, id_col, vector_col, True, "<f4")


def write_ivecs(rows: DataFrame, folder: str, id_col: str = "qid", ids_col: str = "ids") -> int:
    return _write(rows, folder, id_col, ids_col, True, "<i4")


def write_ids(rows: DataFrame, folder: str, id_col: str = "id") -> int:
    """Raw uint64 ids in order."""
    return _write(rows, folder, id_col, id_col, False, "<u8")
