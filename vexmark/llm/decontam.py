"""Benchmark decontamination by greedy string tiling.

*Seeds.* Tokens are lower-cased runs of letters, digits and multi-byte characters. Every ``min_match`` consecutive tokens
are a seed, hashed by a running Karp-Rabin value. Documents and benchmark items are joined on shared seeds; no seed is
dropped for being frequent.

*Tiling.* For each pair that shares a seed, the longest common run of unmarked tokens is looked up again and again (longest
first; ties in order of the item's, then the document's position), and marked on both sides, until none of ``min_match``
tokens is left. Maximal runs come from the seeds at their two ends, which are those with different tokens beside them, so
a run costs the same however long it is. Coverage is the marked share of the item's tokens; runs may lie anywhere, so
reordered passages count in full. Items shorter than ``min_match`` tokens match as a whole.

*Size.* The item seeds go to the executors as one broadcast while there are at most ``broadcast_tokens`` of them. Beyond
that the items are dealt into as many slices as needed, each within the bound, and each slice is one pass over the
documents; the results' union is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .line_dedup import ddl

MIN_MATCH, COVERAGE, BROADCAST_TOKENS = 5, 0.5, 4_000_000
PIECE = 1 << 19
_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int64()), ("item_tokens", pa.int64()), ("coverage", pa.float64())])


class Postings:
    """The places of the items' seeds of one width, in order of seed and of the token on one side of the seed."""

    def __init__(self, seed: np.ndarray, n_tokens: int, beside: np.ndarray, item: np.ndarray, pos: np.ndarray, n_seeds: int) -> None:
        key = seed * (n_tokens + 1) + beside
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.pos, self.wide = key[order], item[order], pos[order], n_tokens + 1
        self.first = np.searchsorted(seed[order], np.arange(n_seeds + 1))

    def count(self, seed: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each seed, the places with another token beside it, as two ranges; ``beside`` -1 agrees with none."""
        lo, hi = self.first[seed], self.first[seed + 1]
        key = seed * self.wide + beside
        same, end = np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")
        none = beside < 0
        return lo, np.where(none, lo, same), np.where(none, lo, end), hi

    def places(self, which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, item, position) of the ranges."""
        n = hi - lo
        k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(which, n), self.item[k], self.pos[k]


class Items:
    """Seeds of a set of benchmark items, sorted for lookup."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, min_match: int) -> None:
        buf, off = T.utf8(texts)
        _, _, before, h = T.word_hashes(buf, off)
        self.ids, self.begin, self.count, self.tokens = ids, before[:-1], np.diff(before), h
        self.min_match = min_match
        self.words = np.unique(h)
        self.tables = []
        for w in sorted({int(min(c, min_match)) for c in self.count if c}):
            rows = np.flatnonzero(self.count >= w) if w == min_match else np.flatnonzero(self.count == w)
            seeds = self.count[rows] - w + 1
            item = np.repeat(rows, seeds)
            pos = np.arange(seeds.sum()) - np.repeat(np.cumsum(seeds) - seeds, seeds)
            at = self.begin[item] + pos
            g, seed = np.unique(grams(h, w)[at], return_inverse=True)
            bits = np.zeros(1 << 20, bool)
            bits[(g >> T.U64(44)).astype(np.int64)] = True
            left = np.where(pos > 0, np.searchsorted(self.words, h[at - 1]), len(self.words))
            more = pos + w < self.count[item]
            right = np.where(more, np.searchsorted(self.words, h[np.where(more, at + w, 0)]), len(self.words))
            self.tables.append((w, bits, g, *(Postings(seed, len(self.words), x, item, pos, len(g)) for x in (left, right))))

    def word(self, h: np.ndarray, there: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of the word h[at] among the items' words; -1 if it is none of them, or not ``there``."""
        x = h[np.where(there, at, 0)]
        k = np.minimum(np.searchsorted(self.words, x), len(self.words) - 1)
        return np.where(there & (self.words[k] == x), k, -1)


def grams(tokens: np.ndarray, w: int) -> np.ndarray:
    """Karp-Rabin hash of each w consecutive tokens."""
    n = max(0, len(tokens) - w + 1)
    h = T.prefix_hash(tokens)
    at = np.arange(n)
    return T.span_hash(h, at, at + w)


def tile(a: np.ndarray, b: np.ndarray, n: np.ndarray, n_item: int, min_match: int) -> int:
    """Tokens of the item marked by greedy string tiling, from the maximal common runs (place in item, in document, length).

    The longest run is marked, the first in the item, then the document, of equals; from the others, none of them longer, what
    it covers on either side is cut off, which leaves one piece of each at most.
    """
    covered = 0
    while len(n) and covered < n_item:
        most = n.max()
        k = np.flatnonzero(n == most)
        k = k[a[k] == a[k].min()]
        k = k[b[k].argmin()]
        covered += int(most)
        for side, begin in ((0, a[k]), (1, b[k])):
            at = b if side else a
            over = (at < begin + most) & (at + n > begin)
            before = over & (at < begin)
            skip = np.where(over & ~before, begin + most - at, 0)
            a, b, n = a + skip, b + skip, np.where(before, begin - at, n - skip)
            keep = n >= min_match
            a, b, n = a[keep], b[keep], n[keep]
    return covered


def runs(items: Items, table: tuple, h: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, item, place in the item, place in the block, length) of all maximal common runs, by rows and items, some rows at a time.

    A run begins where the tokens before two places of a seed differ, and ends where those after them do; on a diagonal the
    beginnings and ends take turns. Places within a run are never listed, so a repetitive text costs no more than another.
    """
    w, bits, g, lefts, rights = table
    grams_ = grams(h, w)
    at = np.flatnonzero(bits[(grams_ >> T.U64(44)).astype(np.int64)])
    k = np.minimum(np.searchsorted(g, grams_[at]), len(g) - 1)
    row = np.searchsorted(before, at, "right") - 1
    fit = (g[k] == grams_[at]) & (at + w <= before[row + 1])
    at, seed, row = at[fit], k[fit], row[fit]
    begins = lefts.count(seed, items.word(h, at > before[row], at - 1))
    ends = rights.count(seed, items.word(h, at + w < before[row + 1], at + w))
    n = np.cumsum(begins[1] - begins[0] + begins[3] - begins[2])
    cut = 0
    while cut < len(at):  # whole rows of about PIECE runs
        far = int(np.searchsorted(n, (n[cut - 1] if cut else 0) + PIECE))
        end = int(np.searchsorted(row, row[min(far, len(at) - 1)], "right"))
        which = np.arange(cut, end)
        sides = []
        for table_, (lo, same, other, hi) in ((lefts, begins), (rights, ends)):
            s = slice(cut, end)
            x, item, pos = (np.concatenate(c) for c in zip(table_.places(which, lo[s], same[s]), table_.places(which, other[s], hi[s]), strict=True))
            order = np.lexsort((pos, at[x] - pos, item, row[x]))
            sides.append((row[x][order], item[order], pos[order], at[x][order]))
        (r, item, a, b), (_, _, a_end, _) = sides
        yield r, item, a, b, a_end - a + w
        cut = end


def covered(items: Items, buf: np.ndarray, off: np.ndarray, coverage: float) -> list[tuple[int, int, int]]:
    """(row, item, tokens tiled) of a block's rows and the items of which they cover enough."""
    _, _, before, h = T.word_hashes(buf, off)
    hits = []
    for table in items.tables:
        for row, item, a, b, length in runs(items, table, h, before):
            cut = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
            if not len(cut):
                continue
            size = np.diff(cut, append=len(row))
            need = coverage * items.count[item[cut]]
            may = np.add.reduceat(length, cut) >= need  # tiles cover at most what the runs do
            for c, m, least in zip(cut[may].tolist(), size[may].tolist(), need[may].tolist(), strict=True):
                t, s = int(item[c]), slice(c, c + m)
                n = tile(a[s], b[s], length[s], int(items.count[t]), min(table[0], items.min_match))
                if n >= least:
                    hits.append((int(row[c]), t, n))
    return sorted(hits)


def _scan(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            ids = batch.column(0)
            for i, _, buf, off in T.text_blocks(batch.column(1)):
                if hits := covered(items, buf, off, coverage):
                    r, t, n = (np.array(x) for x in zip(*hits, strict=True))
                    yield T.batch(_HITS, doc_id=ids.take(pa.array(i + r)), item_id=items.ids[t], covered=n, item_tokens=items.count[t], coverage=n / items.count[t])

    return run


def _clean(shared, coverage: float):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items: Items = shared.value
        for col in texts:
            keep = np.ones(len(col), bool)
            for i, _, buf, off in T.text_blocks(col):
                keep[[i + r for r, _, _ in covered(items, buf, off, coverage)]] = False
            yield pa.array(keep)

    return F.arrow_udf(run, "boolean")


def _slices(benchmark: DataFrame, min_match: int, broadcast_tokens: int, item_id_col: str, item_text_col: str) -> list:
    """Broadcasts of ``Items``, each within the bound."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(item_id_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(size / 2 / broadcast_tokens))  # a token and the space after it are at least two characters
    out = []
    for k in range(slices):
        part = (items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)).toArrow().combine_chunks()
        if part.num_rows:
            out.append(spark.sparkContext.broadcast(Items(part.column("item_id").to_numpy(), part.column("text").combine_chunks(), min_match)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, broadcast_tokens: int = BROADCAST_TOKENS, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, covered, item_tokens, coverage): each document and item of which ``coverage`` or more is tiled.

    Documents and items with null, empty or wordless texts match nothing; neither do items without an id. Documents without
    an id that match have null there. Rows that repeat are each a row of the result. Other columns are not read. Either
    table may be empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = [rows.mapInArrow(_scan(shared, coverage), ddl(_HITS)) for shared in _slices(benchmark, min_match, broadcast_tokens, item_id_col, item_text_col)]
    return reduce(DataFrame.union, found) if found else rows.select("doc_id").where("false").selectExpr("doc_id", "0L AS item_id", "0L AS covered", "0L AS item_tokens", "0D AS coverage")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, broadcast_tokens: int = BROADCAST_TOKENS, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose own text ``contaminated`` finds, with an id or without; columns and other rows as they are.

    Only the texts go to Python and nothing is shuffled; rows with null, empty or wordless texts stay.
    """
    for shared in _slices(benchmark, min_match, broadcast_tokens, item_id_col, item_text_col):
        docs = docs.where(_clean(shared, coverage)(F.col(text_col).cast("string")))
    return docs
