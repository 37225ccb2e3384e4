"""k nearest neighbours, exact.

``knn`` is one query vector: a projection and ``TakeOrderedAndProject``, all inside Catalyst. ``knn_batch`` takes a DataFrame of
queries: vectors stay where they are, queries go to every task, which keeps the best k so far of each query, by a matrix
product with each Arrow batch, and a window takes the best of all tasks'; only k rows a query and task are shuffled. With key
columns a query looks at the vectors of its own key alone, and only those products are made. ``knn_batch_sql`` is the same by
a join of parts, without a broadcast.

Queries are broadcast while they hold at most ``BROADCAST_VALUES`` numbers; beyond that they are dealt into slices within the
bound, each one pass over the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Code, EngineError
from ..functions import vectors as V
from ..types import Metric

BROADCAST_VALUES = 16_000_000
PART_ROWS = 32_768  # rows of a part of ``knn_batch_sql``
_BLOCK = 1 << 19  # scores at a time
_COLUMNS, _FIRST, _PAIRS = 4096, 256, 1 << 15  # vectors at a time, at first, and pairs that are computed exactly at a time
_LEAST = 1e-36  # room for products too small for single precision
_HELD = 8_000_000  # best hits so far that a task keeps; with more of them each batch gives its own
_HITS = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _best_first(metric: Metric) -> list:
    return [F.col("score").asc() if metric.ascending else F.col("score").desc(), F.col("id").asc()]


def _vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    return vectors.where(F.size(vector_col) == dimensions).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("embedding"))


def knn(vectors: DataFrame, query: Sequence[float], k: int, metric: Metric = Metric.COSINE, dimensions: int | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(rank, id, score): the k best, best first, of equals the smaller id. Fewer rows than k give fewer results.

    Raises kDimensionMismatch if the query hasn't ``dimensions`` values; vectors of another size are never found.
    """
    if dimensions is not None and len(query) != dimensions:
        raise EngineError(Code.DIMENSION_MISMATCH, f"query has {len(query)} values, the collection {dimensions}")
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], "rank int, id long, score double")
    scored = _vectors(vectors, id_col, vector_col, len(query)).select("id", V.score(metric, F.col("embedding"), V.literal(query)).alias("score"))
    top = scored.orderBy(*_best_first(metric)).limit(k)
    return top.select(F.row_number().over(Window.orderBy(*_best_first(metric))).alias("rank"), "id", "score")


def check_queries(queries: DataFrame, dimensions: int, vector_col: str = "qv") -> None:
    """kDimensionMismatch if any query has another size: a batch is searched as a whole or not at all."""
    if queries.where(F.coalesce(F.size(vector_col), F.lit(-1)) != dimensions).limit(1).count():
        raise EngineError(Code.DIMENSION_MISMATCH, f"the collection has {dimensions} dimensions")


def ranked(scored: DataFrame, k: int, metric: Metric) -> DataFrame:
    """(qid, rank, id, score): the k best of each query."""
    order = Window.partitionBy("qid").orderBy(*_best_first(metric))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def knn_batch_sql(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric = Metric.COSINE, id_col: str = "id", vector_col: str = "embedding", qid_col: str = "qid", query_col: str = "qv", part_rows: int = PART_ROWS) -> DataFrame:
    """As ``knn_batch``, by a join that Catalyst plans, with nothing broadcast.

    Both sides are dealt into parts of about ``part_rows`` rows; each pair of parts is a group of its own, which gives the k best of each
    of its queries. A group holds its two parts, whatever the size of the tables.
    """
    spark = vectors.sparkSession
    q = queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(query_col).cast("array<float>").alias("qv")).where("qid IS NOT NULL AND qv IS NOT NULL")
    e = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("embedding")).where(F.col("embedding").isNotNull())
    if k <= 0:
        return spark.createDataFrame([], "qid long, rank int, id long, score double")
    least = math.isqrt(spark.sparkContext.defaultParallelism) + 1
    across, down = (max(least, math.ceil(side.count() / part_rows)) for side in (q, e))

    def dealt(rows: DataFrame, id_col: str, vector_col: str, own: str, parts: int, other: str, others: int) -> DataFrame:
        each = rows.withColumns({own: F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int"), "width": F.size(vector_col)})
        return each.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select("across", "down", "width", id_col, vector_col)

    left = dealt(q, "qid", "qv", "across", across, "down", down).groupBy("across", "down", "width")
    right = dealt(e, "id", "embedding", "down", down, "across", across).groupBy("across", "down", "width")
    return ranked(left.cogroup(right).applyInArrow(_part(k, metric), "qid long, id long, score double"), k, metric)


def _part(k: int, metric: Metric):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        width = key[2].as_py()
        if not (left.num_rows and right.num_rows and width):
            return pa.Table.from_batches([], schema=_HITS)
        q, x = (_rows(side.column(4).combine_chunks(), width) for side in (left, right))
        best = Best(len(q), k)
        best.look(metric, q, np.arange(len(q)), x, right.column(3).to_numpy())
        return pa.Table.from_batches([best.hits(left.column(3).to_numpy(), 1.0 if metric.ascending else -1.0)])

    return run


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _rows(col: pa.Array, width: int) -> np.ndarray:
    """``_matrix`` in the vectors' own precision."""
    return (col if isinstance(col, pa.Array) else pa.concat_arrays(col.chunks)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def distances(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(query, vector) of distances, small is near. L2 by differences: the expanded square would lose digits of near pairs."""
    if metric is not Metric.L2:
        return 1.0 - q @ x.T
    out = np.empty((len(q), len(x)))
    for i, v in enumerate(q):
        d = x - v
        out[i] = np.einsum("ij,ij->i", d, d)
    return out


def pair_distances(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The distance of each row of ``q`` to the same row of ``x``, alike for alike rows."""
    if metric is not Metric.L2:
        return 1.0 - np.einsum("ij,ij->i", q, x)
    d = q - x
    return np.einsum("ij,ij->i", d, d)


class Best:
    """The k nearest so far of each of some queries, of equals the smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.far, self.ids = k, np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def look(self, metric: Metric, q: np.ndarray, who: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Search the vectors ``x``, named ``ids``, for the queries ``who``, row numbers of ``q``.

        A product of matrices tells which pairs can't be among the best, with more room than it has rounding errors; the distances of
        the others are then computed one by one in double precision, so they are the same however rows fall into batches. Columns
        come in growing blocks, as a few of them already bound what the rest must reach.
        """
        l2, width = metric is Metric.L2, x.shape[1]
        begin, size = 0, max(_FIRST, 4 * self.k)
        while begin < len(x):
            own, names = x[begin : begin + size].astype(np.float64), ids[begin : begin + size]
            begin, size = begin + len(own), min(4 * size, _COLUMNS)
            squares = np.einsum("ij,ij->i", own, own)
            longest = np.sqrt(np.fmax.reduce(squares, initial=0.0))
            step = max(1, _BLOCK // len(own))
            right = {}
            for i in range(0, len(who), step):
                w = who[i : i + step]
                rows = q[w].astype(np.float64)
                norms = np.einsum("ij,ij->i", rows, rows)
                reach = np.sqrt(norms) + longest if l2 else np.sqrt(norms) * longest
                kind = np.float32 if max(np.fmax.reduce(norms, initial=0.0), longest**2) < 1e15 else np.float64
                if kind not in right:
                    right[kind] = (np.column_stack([own, squares / -2]) if l2 else own).astype(kind).T
                reach = reach * reach if l2 else reach
                room = 4 * (width + 8) * np.finfo(kind).eps * reach + 1e-15 * (1 + reach) * (not l2) + _LEAST  # 1 - dot is rounded too
                near = (np.column_stack([rows, np.ones(len(rows))]) if l2 else rows).astype(kind) @ right[kind]
                edge = self.far[w, -1]
                floor = (norms - edge) / 2 if l2 else 1 - edge
                with np.errstate(invalid="ignore", over="ignore"):
                    floor = np.where(np.isfinite(floor), floor - room - 4 * np.finfo(kind).eps * np.abs(floor), -np.inf)
                    floor[np.isnan(floor)] = -np.inf
                    row, col = np.divmod(np.flatnonzero(near >= floor.astype(kind)[:, None]), len(own))
                    if len(row) > 4 * self.k * len(w) and self.k < len(own):
                        known = np.where(np.isnan(near), kind(-np.inf), near)
                        least = np.partition(known, len(own) - self.k, axis=1)[:, len(own) - self.k].astype(np.float64)
                        least = np.where(np.isfinite(least), least - 2 * room, -np.inf)
                        floor = np.maximum(floor, np.where(np.isnan(least), -np.inf, least))
                        row, col = np.divmod(np.flatnonzero(near >= floor.astype(kind)[:, None]), len(own))
                for j in range(0, len(row), _PAIRS):
                    r, c = row[j : j + _PAIRS], col[j : j + _PAIRS]
                    self._add(w, r, pair_distances(metric, rows[r], own[c]), names[c])

    def _add(self, who: np.ndarray, row: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """Distances ``d`` of the queries ``who[row]`` to the vectors ``ids``; rows ascend."""
        some = np.flatnonzero(d <= self.far[who[row], -1])
        row, d, ids = row[some], d[some], ids[some]
        if not len(row):
            return
        own = row[np.concatenate([[True], row[1:] != row[:-1]])]
        at = np.concatenate([np.repeat(np.arange(len(own)), self.k), np.searchsorted(own, row)])
        far, ids = np.concatenate([self.far[who[own]].ravel(), d]), np.concatenate([self.ids[who[own]].ravel(), ids])
        order = np.lexsort((ids, far, at))
        at = at[order]
        first = np.searchsorted(at, np.arange(len(own)))
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.far[who[own]], self.ids[who[own]] = far[take].reshape(-1, self.k), ids[take].reshape(-1, self.k)

    def hits(self, qids: np.ndarray, sign: float) -> pa.RecordBatch:
        row, col = np.nonzero(self.far < np.inf)
        return pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(self.ids[row, col]), pa.array(sign * self.far[row, col])], schema=_HITS)


def _by_key(keys: pa.Array) -> dict:
    """The places of each value, nulls left out."""
    coded = keys.dictionary_encode()
    at = coded.indices.fill_null(-1).to_numpy()
    order = np.argsort(at, kind="stable")
    begin = np.searchsorted(at[order], np.arange(len(coded.dictionary) + 1))
    return {v: order[begin[i] : begin[i + 1]] for i, v in enumerate(coded.dictionary.to_pylist())}


def _search(shared, k: int, metric: Metric):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, members = shared.value
        sign = 1.0 if metric.ascending else -1.0
        held = len(q) * k <= _HELD
        best = Best(len(q), k) if held else None
        everyone = np.arange(len(q))
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), _rows(b.column(1), q.shape[1])
            parts = [(everyone, slice(None))] if members is None else [(members[v], at) for v, at in _by_key(b.column(2)).items() if v in members]
            for who, at in parts:
                if held:
                    best.look(metric, q, who, x[at], ids[at])
                else:
                    yield from apart(metric, q, qids, who, x[at], ids[at], k)
        if held:
            yield best.hits(qids, sign)

    return run


def apart(metric: Metric, q: np.ndarray, qids: np.ndarray, who: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of one batch, of some queries at a time."""
    step = max(1, 1_000_000 // k)
    for i in range(0, len(who), step):
        w = who[i : i + step]
        best = Best(len(w), k)
        best.look(metric, q[w], np.arange(len(w)), x, ids)
        yield best.hits(qids[w], 1.0 if metric.ascending else -1.0)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric = Metric.COSINE, dimensions: int | None = None, id_col: str = "id", vector_col: str = "embedding", qid_col: str = "qid", query_col: str = "qv", broadcast_values: int = BROADCAST_VALUES, key_col: str | None = None, query_key_col: str | None = None) -> DataFrame:
    """(qid, rank, id, score): each query's k best, as ``knn`` gives them. No queries give no rows.

    With ``key_col`` (and ``query_key_col``, by default the same name) a query finds only vectors whose key equals its own; a null key finds and
    is found by nothing.
    """
    spark = vectors.sparkSession
    if dimensions is not None:
        check_queries(queries, dimensions, query_col)
    own_key = F.col(query_key_col or key_col).alias("key") if key_col else F.lit(0).alias("key")
    q = queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(query_col).cast("array<float>").alias("qv"), own_key).where("qid IS NOT NULL AND qv IS NOT NULL")
    sizes = {r["width"]: r["n"] for r in q.groupBy(F.size("qv").alias("width")).agg(F.count("*").alias("n")).collect()}
    found = []
    for width, n in sorted(sizes.items()) if k > 0 else ():
        own, slices = q.where(F.size("qv") == width), max(1, math.ceil(n * width / broadcast_values))
        rows = vectors.where(F.size(vector_col) == width).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("embedding"), *([F.col(key_col).alias("key")] if key_col else []))
        for s in range(slices):
            part = (own if slices == 1 else own.where(F.pmod(F.xxhash64("qid"), F.lit(slices)) == s)).toArrow().combine_chunks()
            if part.num_rows and width:
                members = _by_key(part.column("key").combine_chunks()) if key_col else None
                shared = spark.sparkContext.broadcast((part.column("qid").to_numpy(), _rows(part.column("qv").combine_chunks(), width), members))
                found.append(rows.mapInArrow(_search(shared, k, metric), "qid long, id long, score double"))
    if not found:
        return spark.createDataFrame([], "qid long, rank int, id long, score double")
    return ranked(reduce(DataFrame.union, found), k, metric)


def with_metadata(hits: DataFrame, metadata: DataFrame, id_col: str = "id", metadata_col: str = "metadata") -> DataFrame:
    """``hits`` with each one's metadata, ``{}`` where there is none."""
    m = metadata.select(F.col(id_col).alias("__mid"), F.col(metadata_col).alias("__meta"))
    return hits.join(m, hits["id"] == F.col("__mid"), "left").withColumn("metadata", F.coalesce("__meta", F.lit("{}"))).drop("__mid", "__meta")
