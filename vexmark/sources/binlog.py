"""The binary change log: a header of 24 bytes, then records of 45 bytes and four for each dimension, little-endian."""

import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Code, EngineError, Status
from ..files import Files
from ..types import MAX_DIMENSION
from .ranges import dealt, each_range, listed, opened, uri

MAGIC, VERSION = 0x41574C01, 1
OPS = {1: "COMMIT_TXN", 2: "ABORT_TXN", 3: "INSERT", 4: "DELETE", 5: "UPDATE", 6: "BATCH_INSERT"}
NUMBERS = {name: n for n, name in OPS.items()}
SCHEMA = "lsn long, txid long, op string, version int, id long, dimension int, embedding array<float>, payload_length long, header_crc long, payload_crc long"
_HEADER = struct.Struct("<IHHQII")
_FRONT = struct.Struct("<HHQQ")
_REST = struct.Struct("<IIQIB")
_MIDDLE = _FRONT.size + _REST.size


@dataclass(frozen=True)
class Header:
    magic: int = MAGIC
    version: int = VERSION
    flags: int = 0
    created: int = 0
    crc: int = 0
    padding: int = 0

    def checked(self) -> "Header":
        """With the checksum that belongs to the other fields."""
        return replace(self, crc=zlib.crc32(self.pack()[:16]))

    def pack(self) -> bytes:
        return _HEADER.pack(self.magic, self.version, self.flags, self.created, self.crc, self.padding)

    def status(self) -> Status:
        if self.magic != MAGIC:
            return Status(Code.BAD_HEADER, f"magic number {self.magic:#x}")
        return Status() if zlib.crc32(self.pack()[:16]) == self.crc else Status(Code.CHECKSUM_MISMATCH, "header")


def parse_header(data: bytes) -> Header:
    if len(data) < _HEADER.size:
        raise EngineError(Code.BAD_HEADER, f"{len(data)} bytes are no header")
    header = Header(*_HEADER.unpack_from(data))
    if not header.status().ok:
        raise EngineError(header.status().code, header.status().message)
    return header


@dataclass(frozen=True)
class Entry:
    op: str
    lsn: int
    txid: int
    id: int = 0
    embedding: tuple[float, ...] = ()
    version: int = VERSION
    dimension: int | None = None
    header_crc: int | None = None
    payload_crc: int | None = None

    def pack(self) -> bytes:
        """Checksums and lengths are worked out anew."""
        front = _FRONT.pack(NUMBERS[self.op], self.version, self.lsn, self.txid)
        payload = np.array(self.embedding, "<f4").tobytes()
        rest = _REST.pack(zlib.crc32(front), len(payload), self.id, len(self.embedding), 0)
        return front + rest + payload + struct.pack("<I", zlib.crc32(payload))

    def status(self) -> Status:
        """Whether the entry is one that a log may hold."""
        n = len(self.embedding) if self.dimension is None else self.dimension
        if self.op not in NUMBERS or n > MAX_DIMENSION or n != len(self.embedding):
            return Status(Code.BAD_RECORD, f"{self.op}, dimension {n}")
        packed = self.pack()
        stored = struct.unpack_from("<I", packed, _FRONT.size)[0], struct.unpack_from("<I", packed, len(packed) - 4)[0]
        for have, want in zip((self.header_crc, self.payload_crc), stored, strict=True):
            if have is not None and have != want:
                return Status(Code.CHECKSUM_MISMATCH, "record")
        return Status()


class Torn(EngineError):
    """The file ends within a record."""


def parse_entry(data: bytes, at: int = 0) -> tuple[Entry, int]:
    """The record at a place, and where the next one begins."""
    if len(data) < at + _MIDDLE:
        raise Torn(Code.IO_ERROR, f"record at {at} is cut off")
    kind, version, lsn, txid = _FRONT.unpack_from(data, at)
    header_crc, _, vector_id, dimension, _ = _REST.unpack_from(data, at + _FRONT.size)
    if kind not in OPS:
        raise EngineError(Code.BAD_RECORD, f"operation {kind} at {at}")
    if dimension > MAX_DIMENSION:
        raise EngineError(Code.BAD_RECORD, f"dimension {dimension} at {at}")
    begin, end = at + _MIDDLE, at + _MIDDLE + 4 * dimension
    if len(data) < end + 4:
        raise Torn(Code.IO_ERROR, f"record at {at} is cut off")
    payload = data[begin:end]
    (payload_crc,) = struct.unpack_from("<I", data, end)
    if zlib.crc32(data[at : at + _FRONT.size]) != header_crc or zlib.crc32(payload) != payload_crc:
        raise EngineError(Code.CHECKSUM_MISMATCH, f"record at {at}")
    return Entry(OPS[kind], lsn, txid, vector_id, tuple(np.frombuffer(payload, "<f4").tolist()), version, dimension, header_crc, payload_crc), end + 4


def entries(data: bytes, tolerate_torn_tail: bool = False) -> Iterator[Entry]:
    """All records after the header; the first bad one raises, but for a torn last one if that is tolerated."""
    if not data:
        raise EngineError(Code.EOF, "empty log")
    parse_header(data)
    at = _HEADER.size
    while at < len(data):
        try:
            entry, at = parse_entry(data, at)
        except Torn:
            if tolerate_torn_tail:
                return
            raise
        yield entry


_ARROW = pa.schema([("lsn", pa.int64()), ("txid", pa.int64()), ("op", pa.string()), ("version", pa.int32()), ("id", pa.int64()), ("dimension", pa.int32()), ("embedding", pa.list_(pa.float32())), ("payload_length", pa.int64()), ("header_crc", pa.int64()), ("payload_crc", pa.int64())])


def _signed(n: int) -> int:
    if n >= 1 << 63:
        raise EngineError(Code.INVALID_ARGUMENT, f"{n} doesn't fit into a signed number")
    return n


def _even(data: bytes) -> pa.RecordBatch | None:
    """All records at once, if they are whole, sound and of one dimension; None otherwise, and then it takes a look at each."""
    if len(data) < _HEADER.size + _MIDDLE:
        return None
    (dimension,) = struct.unpack_from("<I", data, _HEADER.size + _MIDDLE - 5)
    size = _MIDDLE + 4 * dimension + 4
    if dimension > MAX_DIMENSION or (len(data) - _HEADER.size) % size:
        return None
    kind = np.dtype([("op", "<u2"), ("version", "<u2"), ("lsn", "<u8"), ("txid", "<u8"), ("header_crc", "<u4"), ("payload_length", "<u4"), ("id", "<u8"), ("dimension", "<u4"), ("padding", "u1"), ("embedding", "<f4", (dimension,)), ("payload_crc", "<u4")])
    rows, view = np.frombuffer(data, kind, offset=_HEADER.size), memoryview(data)
    if not (np.isin(rows["op"], list(OPS)).all() and (rows["dimension"] == dimension).all() and all((rows[c] < 1 << 63).all() for c in ("lsn", "txid", "id"))):
        return None
    for at, front, payload in zip(range(_HEADER.size, len(data), size), rows["header_crc"].tolist(), rows["payload_crc"].tolist(), strict=True):
        if zlib.crc32(view[at : at + _FRONT.size]) != front or zlib.crc32(view[at + _MIDDLE : at + size - 4]) != payload:
            return None
    names = pa.array([OPS.get(k) for k in range(max(OPS) + 1)], pa.string())
    cols = {c: pa.array(rows[c].astype(np.int64)) for c in ("lsn", "txid", "id", "header_crc", "payload_crc")}
    cols |= dict(op=names.take(pa.array(rows["op"].astype(np.int64))), version=pa.array(rows["version"].astype(np.int32)), dimension=pa.array(rows["dimension"].astype(np.int32)))
    cols["payload_length"] = pa.array(np.full(len(rows), 4 * dimension, np.int64))
    cols["embedding"] = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dimension), pa.array(np.ascontiguousarray(rows["embedding"]).ravel()))
    return pa.RecordBatch.from_arrays([cols[f.name] for f in _ARROW], schema=_ARROW)


def _read(tolerate: bool):
    def read(r: dict) -> Iterator[pa.RecordBatch]:
        with opened(r["path"]) as f:
            data = f.read()
        even = _even(data)
        if even is not None:
            parse_header(data)
            for i in range(0, even.num_rows, 8192):
                yield even.slice(i, 8192)
            return
        rows: list[dict] = []
        for e in entries(data, tolerate):
            rows.append(dict(lsn=_signed(e.lsn), txid=_signed(e.txid), op=e.op, version=e.version, id=_signed(e.id), dimension=e.dimension, embedding=list(e.embedding), payload_length=4 * e.dimension, header_crc=e.header_crc, payload_crc=e.payload_crc))
            if len(rows) == 1024:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return lambda batches: each_range(batches, read)


def read_header(spark: SparkSession, path: str) -> Header:
    files = Files(spark)
    if not files.exists(path):
        raise EngineError(Code.IO_ERROR, f"no log at {path}")
    if files.size(path) == 0:
        raise EngineError(Code.EOF, "empty log")
    with opened(path) as f:
        return parse_header(f.read(_HEADER.size))


def read_log(spark: SparkSession, path: str, tolerate_torn_tail: bool = False) -> DataFrame:
    """The records of a log file, or of a folder of them; records can only be found from a file's start, so a file is a task.

    A header that is bad raises at once; a bad record fails the query.
    """
    files = listed(spark, path)
    for file, _ in files:
        read_header(spark, file)
    whole = max((n for _, n in files), default=0) + 1
    return dealt(spark, files, whole, whole).mapInArrow(_read(tolerate_torn_tail), SCHEMA)


def encode(rows: DataFrame) -> DataFrame:
    """(lsn, record): each row's bytes, from ``lsn, txid, op, id, embedding``."""
    schema = pa.schema([("lsn", pa.int64()), ("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [Entry(r["op"], r["lsn"], r["txid"], r["id"], tuple(r["embedding"] or ())).pack() for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], schema=schema)

    return rows.select("lsn", "txid", "op", "id", "embedding").mapInArrow(run, "lsn long, record binary")


def _write_part(folder: str):
    schema = pa.schema([("part", pa.int32()), ("name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        part = TaskContext.get().partitionId()
        system, at = fs.FileSystem.from_uri(folder)
        name = f"{part:06d}-{uuid.uuid4().hex}"  # a task that is tried again doesn't meet its own remains
        with system.open_output_stream(f"{at}/{name}") as f:
            for b in batches:
                for record in b.column(0):
                    f.write(record.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name])], schema=schema)

    return run


def write_log(rows: DataFrame, path: str, created: int | None = None, flags: int = 0) -> None:
    """One log file in the order of ``lsn``: tasks write their ranges of it, whose bytes are then put one after the other."""
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    parts = system.makeQualified(target.suffix(f".parts-{uuid.uuid4().hex}"))
    system.mkdirs(parts)
    try:
        written = encode(rows).orderBy("lsn").select("record").mapInArrow(_write_part(uri(parts.toString())), "part int, name string").collect()
        out = system.create(target, True)
        try:
            out.write(Header(flags=flags, created=int(time.time()) if created is None else created).checked().pack())
            for _, name in sorted(tuple(r) for r in written):
                piece = system.open(jvm.org.apache.hadoop.fs.Path(parts, name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, conf, False)
                finally:
                    piece.close()
            out.hsync()
        finally:
            out.close()
    finally:
        system.delete(parts, True)


def dump(rows: DataFrame) -> DataFrame:
    """(lsn, json): each record as JSON text."""
    return rows.select("lsn", F.to_json(F.struct(*rows.columns)).alias("json"))


def op_name(number: Column) -> Column:
    """Name of an operation's number; INVALID for others."""
    names = F.create_map(*(F.lit(x) for pair in OPS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, number), F.lit("INVALID"))


def record_status(rows: DataFrame) -> Column:
    """kOk, kBadRecord or kDimensionMismatch of rows (op, dimension, embedding) of a change log."""
    return F.when(~F.col("op").isin(*NUMBERS) | F.col("op").isNull() | (F.col("dimension") > MAX_DIMENSION), "kBadRecord").when(F.col("dimension") != F.coalesce(F.size("embedding"), F.lit(0)), "kBadRecord").otherwise("kOk")


def payload_crc(vector: Column) -> Column:
    """CRC-32 of a vector's bytes; of none for a null."""

    @F.arrow_udf("long")
    def crc(vectors: pa.Array) -> pa.Array:
        data = memoryview(vectors.values.fill_null(0).to_numpy(zero_copy_only=False).astype("<f4")).cast("B")
        ends = vectors.offsets.to_numpy() * 4
        return pa.array([zlib.crc32(data[i:j]) for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.int64())

    return crc(vector.cast("array<float>"))
