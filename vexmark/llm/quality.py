"""Quality classifier: histogram gradient-boosted trees over document statistics.

*Statistics.* Shares of byte classes, word and line shapes, and repetition, all from whole texts; and how strongly the
document's words, and their beginnings of four and of six bytes, lean to one label. That lean is learnt from the labelled rows as smoothed
log-odds of hashed words, each labelled document being judged by the other folds' counts, so the trees never see a lean that
a document's own label went into.

*Trees.* Two models, bad quality and toxicity, are boosted on the logistic loss: features are cut into at most 64 bins by
quantiles, a level's best splits come from gradient and hessian histograms, and leaves are shrunk Newton steps. Finished trees are
flattened into arrays (feature, threshold, left child, value), which numpy walks for a block of documents and all trees of
a model at once.

*Sample.* At most ``max_labelled`` labelled rows are used, those with the smallest hashes of doc_id; they are the only
bounded part. A document is rejected if either probability reaches its threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .line_dedup import ddl

MAX_LABELLED, FOLDS, BUCKETS = 8_000, 5, 1 << 16
TREES, DEPTH, RATE, BINS, L2, MIN_CHILD = 60, 4, 0.2, 64, 1.0, 5.0
BAD_THRESHOLD, TOXIC_THRESHOLD = 0.5, 0.4
_SCORES = pa.schema([("doc_id", pa.int64()), ("p_bad", pa.float64()), ("p_toxic", pa.float64())])
STATS = ["log_bytes", "log_words", "log_lines", "word_bytes", "upper", "digit", "space", "high", "punct", "symbol", "pipe", "stop", "caps_words", "short_words", "long_words", "distinct", "repeat_next", "repeat_top", "words_a_line", "short_lines"]
STRONG = 1.5
BEGINNINGS = (4, 6)
LEANS = ["mean", "most", "least", "strong_sum", "strong_share"]

_CLASS = np.zeros((256, 7), bool)
_CLASS[65:91, 0] = _CLASS[48:58, 1] = True
_CLASS[[9, 10, 32], 2] = True
_CLASS[128:, 3] = True
_CLASS[[ord(c) for c in ".,;:!?'\"-()"], 4] = True
_CLASS[[ord(c) for c in "#$%&*+<=>@[]^_`{}~\\/"], 5] = True
_CLASS[ord("|"), 6] = True


def statistics(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Rows of STATS, and (rows' bounds, word hashes, hashes of words' beginnings) for the leans."""
    n = len(off) - 1
    size = np.diff(off)
    start, end, before, h = T.word_hashes(buf, off)
    width = end - start
    words = np.diff(before)
    row = T.rows_of(before)
    lower = T.prefix_hash(T.LOWER[buf])
    beginnings = [T.span_hash(lower, start, np.minimum(end, start + k)) ^ T.U64(0xABCDEF * k) for k in BEGINNINGS]

    def per_row(flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return np.diff(c[off])

    def over_words(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, x, n)

    classes = [per_row(_CLASS[:, k][buf]) for k in range(7)]
    newline = np.flatnonzero(buf == 10)
    lines = 1 + np.diff(np.searchsorted(newline, off))
    upper = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(_CLASS[:, 0][buf], out=upper[1:])
    caps = (upper[end] - upper[start] >= 2).astype(float)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    key = np.sort((row.astype(T.U64) << T.U64(40)) | (h >> T.U64(24)))
    first = np.flatnonzero(np.diff(key, prepend=T.U64(1) + key[:1]))
    sr = (key >> T.U64(40)).astype(np.int64)
    run = np.diff(first, append=len(h))
    top = np.zeros(n)
    np.maximum.at(top, sr[first], run)
    d, w = np.maximum(size, 1), np.maximum(words, 1)
    line_of = row + np.searchsorted(newline, start)
    in_line = np.bincount(line_of, minlength=n + len(newline))
    begin = np.arange(n) + np.searchsorted(newline, off[:-1])
    short = np.concatenate([[0], np.cumsum((in_line > 0) & (in_line < 4))])
    cols = [np.log1p(size), np.log1p(words), np.log1p(lines), over_words(width) / w, *(c / d for c in classes[:7]), classes[4] / w, over_words(caps) / w, over_words((width <= 2).astype(float)) / w, over_words((width >= 14).astype(float)) / w, np.bincount(sr[first], minlength=n) / w, over_words(same) / w, top / w, words / lines, (short[begin + lines] - short[begin]) / lines]
    return np.stack(cols, axis=1).astype(np.float32), (before, h, *beginnings)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & T.U64(BUCKETS - 1)).astype(np.uint16)


def leans(before: np.ndarray, buckets: list[np.ndarray], odds: list[np.ndarray], table_of: np.ndarray | None = None) -> np.ndarray:
    """Rows of LEANS for each family of buckets and its log-odds table; ``table_of`` gives each row's one of several tables."""
    n, out = len(before) - 1, []
    w = np.maximum(np.diff(before), 1)
    row = T.rows_of(before)
    some = np.diff(before) > 0
    at = before[:-1][some]
    for b, table in zip(buckets, odds, strict=True):
        x = table[b] if table_of is None else table[table_of[row], b]
        most, least = np.zeros(n), np.zeros(n)
        if len(x):
            most[some] = np.maximum.reduceat(x, at)
            least[some] = np.minimum.reduceat(x, at)
        strong = np.maximum(x - STRONG, 0)
        out += [np.bincount(row, x, n) / w, most, least, np.bincount(row, strong, n), np.bincount(row, strong > 0, n) / w]
    return np.stack(out, axis=1).astype(np.float32)


@dataclass
class Trees:
    """A boosted model: one row of flat arrays per tree, in heap order."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        n, t = len(x), len(self.feature)
        node = np.zeros((n, t), np.int64)
        rows, trees = np.arange(n)[:, None], np.arange(t)
        for _ in range(self.depth):
            f = self.feature[trees, node]
            node = 2 * node + 1 + (x[rows, f] > self.threshold[trees, node])
        z = self.bias + self.value[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Histogram gradient boosting on the logistic loss."""
    n, m = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    if not n or y.min() == y.max():
        p = float(y.mean()) if n else 0.0
        return Trees(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf, np.float32), np.zeros((1, leaves)), 20.0 * (2 * p - 1) if n else -20.0, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1], method="lower")).astype(np.float32) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(n, bias)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            k, base = 2**level, 2**level - 1
            local = node - base
            best = np.full(k, 1e-6)
            for j in range(m):
                cell = local * BINS + binned[:, j]
                gs = np.cumsum(np.bincount(cell, g, k * BINS).reshape(k, BINS), axis=1)
                hs = np.cumsum(np.bincount(cell, hess, k * BINS).reshape(k, BINS), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(hs < MIN_CHILD * 0.1) | (ht - hs < MIN_CHILD * 0.1)] = -1
                gain = gain[:, : len(edges[j])]
                if gain.shape[1]:
                    at = gain.argmax(axis=1)
                    won = gain[np.arange(k), at] > best
                    best[won] = gain[np.arange(k), at][won]
                    feature[t, base : base + k][won] = j
                    threshold[t, base : base + k][won] = edges[j][at[won]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, hess, leaves) + L2)
        z += value[t][leaf]
    return Trees(feature, threshold, value, bias, depth)


@dataclass
class Model:
    odds: list[list[np.ndarray]]
    trees: list[Trees]

    def score(self, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        stats, (before, *hashes) = statistics(buf, off)
        buckets = [bucket(h) for h in hashes]
        return [tr.probability(np.concatenate([stats, leans(before, buckets, o)], axis=1)) for o, tr in zip(self.odds, self.trees, strict=True)]


def _log_odds(docs_with: list[np.ndarray], n: list[float]) -> np.ndarray:
    """Smoothed log-odds of a bucket occurring in a document of label 1 against label 0."""
    return (np.log((docs_with[1] + 0.5) / (n[1] + 1)) - np.log((docs_with[0] + 0.5) / (n[0] + 1)) - np.log((n[0] + 1) / (n[1] + 1)) * (docs_with[0] + docs_with[1] == 0)).astype(np.float32)


def fit(texts: pa.Array, labels: list[np.ndarray]) -> Model:
    """One set of trees for each of the 0/1 label arrays; a label below 0 is unknown."""
    n, kinds = len(texts), 1 + len(BEGINNINGS)
    fold = np.arange(n) % FOLDS
    blocks, stats = [], []
    counts = np.zeros((len(labels), kinds, 2, FOLDS, BUCKETS), np.int32)
    for i, j, buf, off in T.text_blocks(texts):
        s, (before, *hashes) = statistics(buf, off)
        words = [bucket(h) for h in hashes]
        stats.append(s)
        blocks.append((i, j, before, words))
        row = T.rows_of(before)
        for k, w in enumerate(words):
            u = np.unique(row * BUCKETS + w)  # a word counts once a document
            r, b = i + u // BUCKETS, u % BUCKETS
            for count, y in zip(counts, labels, strict=True):
                known = y[r] >= 0
                np.add.at(count[k], (y[r[known]], fold[r[known]], b[known]), 1)
    x = np.concatenate(stats) if stats else np.zeros((0, len(STATS)), np.float32)
    odds, trees = [], []
    for count, y in zip(counts, labels, strict=True):
        sizes = np.array([[((y == c) & (fold == k)).sum() for k in range(FOLDS)] for c in (0, 1)], float)
        all_n = sizes.sum(axis=1)
        table, others = [], []
        for c in count:
            all_c = c.sum(axis=1)
            table.append(_log_odds(list(all_c), list(all_n)))
            others.append(np.stack([_log_odds(list(all_c - c[:, k]), list(all_n - sizes[:, k])) for k in range(FOLDS)]))
        parts = [leans(before, words, others, fold[i:j]) for i, j, before, words in blocks]
        known = y >= 0
        odds.append(table)
        features = np.concatenate([x, np.concatenate(parts) if parts else np.zeros((0, kinds * len(LEANS)), np.float32)], axis=1)
        trees.append(boost(features[known], y[known].astype(float)))
    return Model(odds, trees)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the labelled documents; quality 0 and toxic 1 are the positive classes, and a null label is unknown.

    Of rows that repeat a doc_id the least text counts, so what the driver gets is bounded by ``max_labelled`` texts.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__q_id")).agg(F.max(1 - F.col("quality")).alias("bad"), F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("__q_id"), "__q_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("__d_id"), F.col(text_col).cast("string").alias("__d_text"))
    table = rows.join(F.broadcast(picked), F.col("__d_id") == F.col("__q_id")).groupBy("__d_id").agg(F.min("__d_text").alias("__d_text"), F.coalesce(F.first("bad"), F.lit(-1)).cast("int").alias("bad"), F.coalesce(F.first("toxic"), F.lit(-1)).cast("int").alias("toxic"))
    got = table.toArrow().sort_by([("__d_id", "ascending"), ("__d_text", "ascending")]).combine_chunks()
    return fit(pa.chunked_array(got.column("__d_text")).combine_chunks(), [got.column(c).to_numpy() for c in ("bad", "toxic")])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for b in batches:
            for i, j, buf, off in T.text_blocks(b.column(1)):
                bad, toxic = model.score(buf, off)
                yield T.batch(_SCORES, doc_id=b.column(0).slice(i, j - i), p_bad=bad, p_toxic=toxic)

    return run


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_bad, p_toxic) of every row. A null text scores as an empty one; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees and tables of one fixed size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(shared), ddl(_SCORES))


def classify(docs: DataFrame, labels: DataFrame, bad_threshold: float = BAD_THRESHOLD, toxic_threshold: float = TOXIC_THRESHOLD, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_bad, p_toxic, keep) of every row, by a model fitted on the labelled ones.

    Rows that repeat are scored each; null ids come back null. Labels of ids that ``docs`` lacks are ignored, though they count
    towards ``max_labelled``, and of conflicting labels the worse counts. Without any labels of a kind nothing is rejected for
    it. An empty table gives an empty result.
    """
    model = train(docs, labels, max_labelled, id_col, text_col)
    return scores(docs, model, id_col, text_col).withColumn("keep", (F.col("p_bad") < bad_threshold) & (F.col("p_toxic") < toxic_threshold))


def _filter(shared, bad_threshold: float, toxic_threshold: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, j, buf, off in T.text_blocks(b.column(text_at)):
                bad, toxic = model.score(buf, off)
                keep[i:j] = (bad < bad_threshold) & (toxic < toxic_threshold)
            yield b.filter(pa.array(keep))

    return run


def drop_rejected(docs: DataFrame, labels: DataFrame, bad_threshold: float = BAD_THRESHOLD, toxic_threshold: float = TOXIC_THRESHOLD, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``classify`` rejects, in one pass and without a shuffle; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled, id_col, text_col))
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names with dots can't be resolved otherwise
    return plain.mapInArrow(_filter(shared, bad_threshold, toxic_threshold, docs.columns.index(text_col)), plain.schema).toDF(*docs.columns)
