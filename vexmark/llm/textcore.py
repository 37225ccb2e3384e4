"""Vectorised access to text held in Arrow buffers.

Every Python-side operator of this package works on the raw UTF-8 bytes of an Arrow batch: a string column is viewed
as one ``uint8`` array plus row offsets (no copy, no Python strings) and words, lines and hashes of arbitrary spans
come out of a handful of numpy passes. Blocks of about a megabyte keep the temporaries small; a text longer than a
block is a block of its own, so nothing is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_PINV = pow(_P, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of a word: ASCII letters and digits, and every byte of a multi-byte character
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True
#: bytes of a token: all but ASCII white space
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before each as it takes not to be a column of ``df``."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    bufs = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def text_blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each block of a column."""
    buf, off = utf8(col)
    for i, j in blocks(off, limit):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, BLOCK_BYTES + 8)
            for name, base in (("up", _P), ("down", _PINV)):
                steps = np.full(n, base, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


POWERS = _Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] the polynomial hash of values[s:e], shifted by the power of s."""
    n = len(values)
    up, _ = POWERS.get(n + 1)
    h = np.zeros(n + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[:n], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of the spans [start, end): running Karp-Rabin values, finalised with the length."""
    _, down = POWERS.get(len(h) + 1)
    x = (h[end] - h[start]) * down[start]
    x += (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(x)


def spans(buf: np.ndarray, off: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of ``member`` bytes within a row; and how many runs lie before each row."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    m = member[buf]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    cut = off[(off > 0) & (off < n)]
    s[cut] = m[cut]
    e[cut - 1] = m[cut - 1]
    start = np.flatnonzero(s)
    return start, np.flatnonzero(e) + 1, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, off: np.ndarray, member: np.ndarray = WORD, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, runs before each row, hash) of the words of a block."""
    start, end, before = spans(buf, off, member)
    h = prefix_hash(LOWER[buf] if lower else buf)
    return start, end, before, span_hash(h, start, end)


def rows_of(before: np.ndarray) -> np.ndarray:
    """The row that each run belongs to."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def sequence_hash(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of values[first[i]:first[i]+count[i]] for each i."""
    return span_hash(prefix_hash(values), first, first + count)


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h, U64).view(np.int64)


def char_offsets(buf: np.ndarray) -> np.ndarray:
    """For each byte offset 0..n the number of characters that begin before it."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def batch(schema: pa.Schema, **cols: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)
