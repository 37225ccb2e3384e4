"""Document fingerprints of improbable features: byte windows of rare entropy in chained Bloom filters.

*Features.* Every 64 consecutive bytes of a text are a window; its Shannon entropy falls into one of 1000 classes. How many
windows each class has is counted over the whole corpus, and the rarer a class, the better its rank; classes of very low
entropy, such as runs of one byte, come last. In every span of 64 neighbouring windows the one of best rank, the leftmost of
equals, gets a point, and windows of 16 points or more are the text's features. Spans never reach into another text. A text
shorter than a window is one feature as a whole.

*Digest.* A feature's Karp-Rabin hash sets five bits of a Bloom filter of 2048. A filter takes 160 features; then the next
one of the chain begins.

*Comparison.* Two filters with a and b bits set share ab/2048 by chance, e; their overlap o counts as (o - e) / (max(a, b) - e),
0 at least. A digest's overlap with another is the mean, by bits, of each filter's best overlap; the smaller of both
directions is the similarity of the two, between 0 and 1.

*Search.* Digests that are equal are one node. Of each node 16 keys, each the hash of two minima of its features under random
orders, go into a shuffle, and within a key's bucket all nodes are compared with each other; documents of similarity ``match``
or more agree in a key with a probability of 0.95 or more. Of buckets with the same nodes one is compared. A bucket of more
than PIECE nodes is split into chunks, and each two chunks, and each chunk by itself, are a piece of their own, so a hot bucket
spreads over tasks; its work grows with the square of its nodes, none of which is left out. A piece sends each node's best
match and a spanning star of each set of nodes that matches connect, so what leaves it is linear in its nodes; the stars'
connected components are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .graph import checkpointed, components
from .line_dedup import ddl

WINDOW, SPAN, POINTS, CLASSES, LOW_CLASS = 64, 64, 16, 1000, 100
FILTER_BITS, PER_FILTER, SUBHASHES = 2048, 160, 5
KEYS, MINIMA, MATCH = 16, 2, 0.6
PIECE, TILE = 2048, 1024
CHUNK = 1 << 16
_BYTES = FILTER_BITS // 8
_UNIT = 1 << 12
_F = np.array([0, *(round(_UNIT * c * np.log2(c)) for c in range(1, WINDOW + 2))], np.int32)
_GAIN = np.diff(_F)
_MOST = int(_UNIT * WINDOW * np.log2(WINDOW))
_POPCOUNT_SCHEMA = pa.schema([("cls", pa.int32()), ("n", pa.int64())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("digest", pa.binary()), ("keys", pa.binary())])
_KEYS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64())])
_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("root", pa.int64()), ("match_id", pa.int64()), ("similarity", pa.float64())])


def entropy_classes(buf: np.ndarray) -> np.ndarray:
    """Class of the window that begins at each byte, in integers throughout; the last WINDOW - 1 bytes begin none."""
    n = len(buf) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    out = np.empty(n, np.int32)
    for c in range(0, n, CHUNK):
        m = min(CHUNK, n - c)
        b = buf[c : c + m + WINDOW - 1]
        after, before = np.zeros(len(b), np.uint8), np.zeros(len(b), np.uint8)
        for s in range(1, WINDOW):
            same = (b[:-s] == b[s:]).view(np.uint8)
            after[:-s] += same
            before[s:] += same
        x = out[c : c + m]
        x[0] = _F[np.bincount(b[:WINDOW])].sum()
        x[1:] = _GAIN[before[WINDOW:]]
        x[1:] -= _GAIN[after[: m - 1]]
        np.cumsum(x, out=x)
    return ((_MOST - out.astype(np.int64)) * CLASSES // (_MOST + 1)).astype(np.int32)


def whole_windows(off: np.ndarray) -> np.ndarray:
    """Whether the window at each byte lies within one row."""
    size = np.diff(off)
    left = np.repeat(off[1:], size) - np.arange(off[-1])
    return left >= WINDOW


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each class, 0 for the rarest."""
    order = np.lexsort((np.arange(CLASSES), counts, np.arange(CLASSES) < LOW_CLASS))
    out = np.empty(CLASSES, np.int32)
    out[order] = np.arange(CLASSES)
    return out


def features(buf: np.ndarray, off: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the features of a block, in order of place."""
    n, size = len(buf), np.diff(off)
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    start = off[:-1][short]
    end = off[1:][short]
    if n >= WINDOW:
        value = np.full(n + 2 * SPAN, CLASSES, np.int32)
        whole = whole_windows(off)[: n - WINDOW + 1]
        value[SPAN : SPAN + len(whole)] = np.where(whole, rank[entropy_classes(buf)], CLASSES)
        points = np.zeros(n + 2 * SPAN + CHUNK, np.int32)
        for c in range(0, n + SPAN, CHUNK):
            v = value[c : c + CHUNK + SPAN - 1]
            key = (v << 17) | np.arange(len(v), dtype=np.int32)
            step = 1
            while step < SPAN:
                key = np.minimum(key[:-step], key[step:])
                step *= 2
            key = key[(key >> 17) < CLASSES] & ((1 << 17) - 1)
            got = np.bincount(key)
            points[c : c + len(got)] += got.astype(np.int32)
        at = np.flatnonzero(points >= POINTS) - SPAN
        start, end = np.concatenate([start, at]), np.concatenate([end, at + WINDOW])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, T.U64)
    return np.searchsorted(off, start, "right") - 1, T.span_hash(T.prefix_hash(buf), start, end)


def filters(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(filters as rows of bytes, how many filters each of the n rows has)."""
    count = np.bincount(row, minlength=n)
    chain = -(-count // PER_FILTER)
    place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    which = (np.cumsum(chain) - chain)[row] + place // PER_FILTER
    bits = np.zeros((int(chain.sum()), FILTER_BITS), np.uint8)
    for k in range(SUBHASHES):
        bits[which, ((h >> T.U64(11 * k)) & T.U64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1), chain


def search_keys(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """(row, key) of the minima's hashes; rows without features have no meaning."""
    out = np.zeros((n, KEYS), T.U64)
    if not len(row):
        return out
    first = np.flatnonzero(np.diff(row, prepend=-1))
    some = row[first]
    for k in range(KEYS):
        x = np.full(len(first), k + 1, T.U64)
        for m in range(MINIMA):
            salt = T.U64((0x9E3779B97F4A7C15 * (2 * (k * MINIMA + m) + 1)) & 0xFFFFFFFFFFFFFFFF)
            x = T.mix(x * T.U64(31) + np.minimum.reduceat(T.mix(h ^ salt), first))
        out[some, k] = x
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(CLASSES, np.int64)
    for b in batches:
        for _, _, buf, off in T.text_blocks(b.column(0)):
            if len(buf) >= WINDOW:
                n += np.bincount(entropy_classes(buf)[whole_windows(off)[: len(buf) - WINDOW + 1]], minlength=CLASSES)
    some = np.flatnonzero(n)
    yield T.batch(_POPCOUNT_SCHEMA, cls=some.astype(np.int32), n=n[some])


def class_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Windows of each entropy class in all texts."""
    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count, ddl(_POPCOUNT_SCHEMA)).groupBy("cls").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES, np.int64)
    out[got.column("cls").to_numpy()] = got.column("n").to_numpy()
    return out


def _packed(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _digest(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in T.text_blocks(b.column(1)):
                n = j - i
                row, h = features(buf, off, rank)
                packed, chain = filters(row, h, n)
                keys = search_keys(row, h, n)
                yield T.batch(_DIGESTS, doc_id=b.column(0).slice(i, n), n_features=np.bincount(row, minlength=n), digest=_packed(packed, chain * _BYTES), keys=_packed(keys, np.full(n, 8 * KEYS)))

    return run


def _digests(docs: DataFrame, counts: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_digest(ranks(counts)), ddl(_DIGESTS))


def digests(docs: DataFrame, counts: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, digest) of every row; ``counts`` are another corpus's ``class_counts``, to compare with its digests."""
    return _digests(docs, class_counts(docs, text_col) if counts is None else counts, id_col, text_col).drop("keys")


def _overlaps(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap of each of x's filters, rows of bits of which a are set, with each of y's."""
    a, b = a[:, None], b[None, :]
    chance = a * b / FILTER_BITS
    return np.clip(((x @ y.T) - chance) / np.maximum(np.maximum(a, b) - chance, 1e-9), 0, 1)


def similarity(x: bytes, y: bytes) -> float:
    """Similarity of two digests, some of their filters at a time; 0 if one has no filter."""
    if not x or not y:
        return 0.0
    f, g = (np.frombuffer(d, np.uint8).reshape(-1, _BYTES) for d in (x, y))
    a, b = (np.bitwise_count(p).sum(axis=1, dtype=np.int64).astype(np.float64) for p in (f, g))
    best_f, best_g = np.zeros(len(f)), np.zeros(len(g))
    for i in range(0, len(f), TILE):
        u = np.unpackbits(f[i : i + TILE], axis=1).astype(np.float32)
        for j in range(0, len(g), TILE):
            s = _overlaps(u, np.unpackbits(g[j : j + TILE], axis=1).astype(np.float32), a[i : i + TILE], b[j : j + TILE])
            np.maximum(best_f[i : i + TILE], s.max(axis=1), out=best_f[i : i + TILE])
            np.maximum(best_g[j : j + TILE], s.max(axis=0), out=best_g[j : j + TILE])
    return float(min((best_f * a).sum() / a.sum(), (best_g * b).sum() / b.sum()))


class Chains:
    """Some digests' filters, for ``similarities``."""

    def __init__(self, digests: list[bytes]) -> None:
        self.digests = digests
        size = np.array([len(d) for d in digests]) // _BYTES
        self.first, self.long = np.cumsum(size) - size, int(size.sum()) > TILE  # then it is one digest
        if self.long:
            return
        self.bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, _BYTES), axis=1).astype(np.float32)
        self.ones = self.bits.sum(axis=1).astype(np.float64)
        self.total = np.add.reduceat(self.ones, self.first)


def similarities(x: Chains, y: Chains) -> np.ndarray:
    """``similarity`` of each of x's digests with each of y's."""
    if x.long or y.long:
        return np.array([[similarity(d, e) for e in y.digests] for d in x.digests])
    best, a, b = _overlaps(x.bits, y.bits, x.ones, y.ones), x.ones[:, None], y.ones[None, :]
    if best.shape == (len(x.first), len(y.first)):  # one filter each
        return best
    there = np.add.reduceat(np.maximum.reduceat(best, y.first, axis=1) * a, x.first, axis=0) / x.total[:, None]
    back = np.add.reduceat(np.maximum.reduceat(best, x.first, axis=0) * b, y.first, axis=1) / y.total[None, :]
    return np.minimum(there, back)


def _tiles(at: np.ndarray, digests: list[bytes]) -> list[np.ndarray]:
    """``at`` in runs of at most TILE filters, or one digest."""
    ends = np.cumsum([len(digests[i]) // _BYTES for i in at])
    out, begin = [], 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TILE, "right")))
        out.append(at[begin:end])
        begin = end
    return out


def _roots(near: np.ndarray) -> np.ndarray:
    """Each row's smallest connected row."""
    label = np.full(len(near), -1)
    for u in range(len(near)):
        front = np.array([u]) if label[u] < 0 else np.zeros(0, np.int64)
        label[front] = u
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & (label < 0))
            label[front] = u
    return label


def _matches(row: np.ndarray, doc: np.ndarray, side: np.ndarray, digests: list[bytes], match: float) -> pa.RecordBatch:
    """Of a piece's nodes, in the order of doc_id, those with a match: their best one and the first node that matches connect them to."""
    n = len(row)
    near, most, best = np.zeros((n, n), bool), np.full(n, -1.0), np.zeros(n, np.int64)
    sides = [_tiles(np.flatnonzero(side == k), digests) for k in np.unique(side)]
    if len(sides) == 1:
        pairs = [(x, y) for i, x in enumerate(sides[0]) for y in sides[0][i:]]
    else:
        pairs = [(x, y) for x in sides[0] for y in sides[1]]
    made = None
    for x, y in pairs:
        if made is None or made[0] is not x:
            made = x, Chains([digests[i] for i in x])
        s = similarities(made[1], made[1] if y is x else Chains([digests[i] for i in y]))
        hit = (s >= match) & (doc[x][:, None] != doc[y][None, :])
        if not hit.any():
            continue
        near[np.ix_(x, y)] |= hit
        near[np.ix_(y, x)] |= hit.T
        for u, v, t, h in ((x, y, s, hit), (y, x, s.T, hit.T)):
            t = np.where(h & (doc[v][None, :] < doc[u][:, None]), t, -1.0)
            k = t.argmax(axis=1)
            t, d = t[np.arange(len(u)), k], doc[v[k]]
            better = (t > most[u]) | ((t == most[u]) & (t >= 0) & (d < best[u]))
            most[u[better]], best[u[better]] = t[better], d[better]
    root = _roots(near)
    hit = np.flatnonzero((root != np.arange(n)) | (most >= 0))
    none = most[hit] < 0
    return T.batch(_FOUND, row=row[hit], doc_id=doc[hit], root=doc[root[hit]], match_id=pa.array(best[hit], mask=none), similarity=pa.array(most[hit], mask=none))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keys = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
            yield T.batch(_KEYS, key=keys, doc_id=np.repeat(b.column(0).to_numpy(), KEYS), row=np.repeat(b.column(1).to_numpy(), KEYS))


def _compare(match: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def piece() -> pa.RecordBatch:
            row, doc, side = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (2, 3, 4))
            return _matches(row, doc, side, [d for b in held for d in b.column(5).to_pylist()], match)

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            begin = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1), b.num_rows]
            for i, j in zip(begin[:-1], begin[1:], strict=True):
                if held and (key[i], part[i]) != last:
                    yield piece()
                    held = []
                held.append(b.slice(i, j - i))
                last = key[i], part[i]
        if held:
            yield piece()

    return run


def _found(nodes: DataFrame, digest: DataFrame, match: float, piece: int) -> DataFrame:
    """The nodes with a match in each piece of each bucket; see ``_matches``."""
    keyed = nodes.select("doc_id", "row", "keys").mapInArrow(_spread, ddl(_KEYS))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x1"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("x2")).where("n > 1")
    buckets = buckets.groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / piece).alias("chunks"))
    members = keyed.join(buckets, "key").withColumn("side", F.when(F.col("chunks") > 1, F.expr("pmod(xxhash64(row), chunks)")).otherwise(0).cast("long"))
    parts = F.expr("explode(transform(sequence(0L, chunks - 1), c -> least(c, side) * chunks + greatest(c, side)))")
    pieces = members.select("key", parts.alias("part"), "row", "doc_id", "side").join(digest, "row").select("key", "part", "row", "doc_id", "side", "digest")
    return pieces.repartition("key", "part").sortWithinPartitions("key", "part", "doc_id", "row").mapInArrow(_compare(match), ddl(_FOUND))


def fingerprint(docs: DataFrame, match: float = MATCH, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_features, digest, match_id, similarity): every row's digest and a document of smaller doc_id that it matches.

    Of the documents that share a key, the most similar of at least ``match`` is reported, of equals the smallest doc_id; a
    document whose digest equals that of others has the smallest of their doc_ids, with similarity 1. ``match_id`` and
    ``similarity`` are null where there is none: always for null and empty texts, which have an empty digest, and for rows
    without an id. ``group_col`` names a further column for the smallest doc_id that matches, of whatever doc_ids, connect
    with the row's: its own if there are none. Repeated rows are rows of the result and never match their own doc_id. Other
    columns are not read. An empty table gives an empty result.
    """
    made = checkpointed(_digests(docs, class_counts(docs, text_col), id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    known = made.where("doc_id IS NOT NULL AND n_features > 0").withColumns({"h1": F.xxhash64("digest"), "h2": F.xxhash64("digest", F.lit(1))})
    nodes = checkpointed(known.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "keys")).alias("n")).select("h1", "h2", "n.*"))
    copies = known.select("h1", "h2", "doc_id", "row").join(nodes.select("h1", "h2", F.col("doc_id").alias("match_id")), ["h1", "h2"]).where("doc_id <> match_id").select("row", "doc_id", F.col("match_id").alias("root"), "match_id", F.lit(1.0).alias("similarity"))
    found = checkpointed(_found(nodes, made.select("row", "digest"), match, piece).union(copies))
    best = found.where("match_id IS NOT NULL").groupBy("row").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "match_id")).alias("b")).select("row", "b.match_id", (-F.col("b.s")).alias("similarity"))
    out = made.join(best, "row", "left").select("doc_id", "n_features", "digest", "match_id", "similarity")
    if group_col is None:
        return out
    group = components(found.selectExpr("doc_id AS a", "root AS b"))
    return out.join(group, F.col("doc_id") == F.col("node"), "left").select(*out.columns, F.coalesce("root", "doc_id").alias(group_col))
