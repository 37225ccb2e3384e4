"""Best-fit packing of documents into training sequences, improved by swaps.

*Lengths.* A text's tokens are its words (runs of letters, digits and multi-byte characters) and its other non-space bytes,
or those of a public tokenizer's vocabulary file if ``tokenizer_path`` names one. A document longer than ``capacity`` is
cut into pieces of that length, which fill bins of their own, and one shorter piece.

*Shards.* Documents are dealt by hash of doc_id into shards of about ``shard_docs`` of them or, if they are short, of
``shard_bytes`` of text, so that a shard fills some five hundred bins; only ids and lengths are shuffled, and shards are packed
independently, so cost is linear in the input and the loss is below one bin a shard.

*Packing.* Best-fit decreasing first. Then local search between bins that aren't full: starting from the emptiest, a piece
moves to another bin, or one or two pieces go there in exchange for one smaller than them, whenever that makes the sum of
squared fills larger, the largest gain first (ties: move before one-for-one before two-for-one, then the earlier bin).
It ends when no exchange is left, or when there are no more bins than the total length needs, as then none can be emptied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .line_dedup import ddl

CAPACITY, SHARD_DOCS, SHARD_BYTES = 2048, 2048, 4 << 20
_LENGTHS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("deal", pa.int64())])
_BINS = pa.schema([("bin_id", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
_SIGN = T.NONSPACE & ~T.WORD


def count_tokens(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    signs = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_SIGN[buf], out=signs[1:])
    return np.diff(T.spans(buf, off)[2]) + np.diff(signs[off])


def _lengths(tokenizer_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(tokenizer_path)
            tok.encode_special_tokens = True
        for b in batches:
            for i, j, buf, off in T.text_blocks(b.column(1)):
                if tokenizer_path:
                    texts = [t or "" for t in b.column(1).slice(i, j - i).to_pylist()]
                    n = np.array([len(e) for e in tok.encode_batch(texts, add_special_tokens=False)], np.int64)
                else:
                    n = count_tokens(buf, off)
                ids = b.column(0).slice(i, j - i)
                # rows without an id are dealt by text and place, so many of them spread
                place = T.signed(T.mix(T.span_hash(T.prefix_hash(buf), off[:-1], off[1:]) + np.arange(j - i).astype(T.U64)))
                yield T.batch(_LENGTHS, doc_id=ids, n_tokens=n, deal=pc.coalesce(ids, pa.array(place)))

    return run


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``sizes`` (descending, each at most ``capacity``): each goes where the least space is left."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s: some bin has s left
    for i, n in enumerate(sizes):
        fit = spaces >> n
        if fit:
            s = n + (fit & -fit).bit_length() - 1
            k = by_space[s].pop()
            if not by_space[s]:
                spaces &= ~(1 << s)
            bins[k].append(i)
            s -= n
        else:
            k, s = len(bins), capacity - n
            bins.append([i])
        if s:
            by_space[s].append(k)
            spaces |= 1 << s
    return bins


def _largest(sizes: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The largest of ``sizes`` (ascending) within each limit; 0 if there is none."""
    if not len(sizes):
        return np.zeros(len(limit), np.int64)
    at = np.searchsorted(sizes, limit, "right")
    return np.where(at > 0, sizes[np.maximum(at - 1, 0)], 0)


def exchange(own: np.ndarray, fill: int, spaces: np.ndarray, fills: np.ndarray, pieces: np.ndarray, owner: np.ndarray) -> tuple[list[int], int, int | None] | None:
    """The best exchange from a bin with the piece sizes ``own`` to one of several targets.

    ``pieces`` are the targets' pieces, ``owner`` their targets. (sizes that go, target, place in ``pieces`` that comes back or
    None); None if no exchange makes the sum of squared fills larger. A net shift of d to a target that is fuller by h
    changes it by 2d(h + d), so of the shifts that fit, d > max(0, -h), the largest is a target's best.
    """
    one, count = np.unique(own, return_counts=True)
    i, j = np.triu_indices(len(one))
    twin = (i != j) | (count[i] > 1)
    pair, at = np.unique(one[i[twin]] + one[j[twin]], return_index=True)
    first, second = one[i[twin]][at], one[j[twin]][at]
    ahead = fills - fill
    best, what = 0, None
    for kind, sums, target, back in (("move", one, np.arange(len(spaces)), 0), ("one", one, owner, pieces), ("two", pair, owner, pieces)):
        if not len(target):
            continue
        go = _largest(sums, spaces[target] + back)
        d = np.where(go > 0, go - back, 0)
        gain = np.where(d > np.maximum(0, -ahead[target]), 2 * d * (ahead[target] + d), 0)
        k = int(gain.argmax())
        if gain[k] > best:
            best = int(gain[k])
            n = int(np.searchsorted(pair, go[k]))
            sizes = [int(first[n]), int(second[n])] if kind == "two" else [int(go[k])]
            what = (sizes, int(target[k]), None if kind == "move" else k)
    return what


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search between the bins that aren't full; the bins that are left, none of them empty.

    A bin that has no exchange is looked at again only with the bins that changed since.
    """
    need = -(-sum(sizes) // capacity)
    size, at = np.array(sizes, np.int64), np.zeros(len(sizes), np.int64)
    for k, b in enumerate(bins):
        at[b] = k
    fill = np.bincount(at, size, len(bins)).astype(np.int64)
    open_ = np.flatnonzero(fill[at] < capacity)  # pieces that may move
    changed, seen = np.ones(len(bins), np.int64), np.zeros(len(bins), np.int64)
    now, alive = 1, len(bins)
    while alive > need:
        wait = np.flatnonzero((fill > 0) & (fill < capacity) & (seen < now))
        if not len(wait):
            break
        a = int(wait[fill[wait].argmin()])
        target = np.flatnonzero((fill > 0) & (fill < capacity) & (changed > seen[a]))
        target = target[target != a]
        if seen[a] < changed[a]:
            target = np.flatnonzero((fill > 0) & (fill < capacity))
            target = target[target != a]
        number = np.full(len(bins), -1, np.int64)
        number[target] = np.arange(len(target))
        own, other = open_[at[open_] == a], open_[number[at[open_]] >= 0]
        found = exchange(size[own], int(fill[a]), capacity - fill[target], fill[target], size[other], number[at[other]]) if len(target) else None
        if found is None:
            seen[a] = now
            continue
        left, b = own.tolist(), int(target[found[1]])
        now += 1
        for n in found[0]:
            k = next(k for k in left if size[k] == n)
            left.remove(k)
            at[k] = b
            fill[a] -= n
            fill[b] += n
        if found[2] is not None:
            k = other[found[2]]
            at[k] = a
            fill[a] += size[k]
            fill[b] -= size[k]
        changed[a] = changed[b] = now
        if not fill[a]:
            alive -= 1
        if fill[b] == capacity or fill[a] == capacity:
            open_ = open_[fill[at[open_]] < capacity]
    order = np.argsort(at, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []
    return [p.tolist() for p in parts]


def pack(ids: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[list[list[int]], list[list[int]], list[list[int]]]:
    """(documents by their place in ``ids``, starts, lengths) of each bin of one shard."""
    order = np.lexsort((ids, -lengths))
    full = lengths[order] // capacity
    who = np.repeat(order, full)
    out_docs = [[int(i)] for i in who]
    out_starts = [[int(s) * capacity] for s in np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)]
    out_lengths = [[capacity]] * len(out_docs)
    rest = lengths % capacity
    keep = np.flatnonzero(rest)
    keep = keep[np.lexsort((ids[keep], -rest[keep]))]
    sizes, owner, begin = rest[keep].tolist(), keep.tolist(), (lengths[keep] - rest[keep]).tolist()
    for b in improve(best_fit(sizes, capacity), sizes, capacity):
        out_docs.append([owner[i] for i in b])
        out_starts.append([begin[i] for i in b])
        out_lengths.append([sizes[i] for i in b])
    return out_docs, out_starts, out_lengths


def _shards(capacity: int):
    def packed(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.concat_arrays([b.column(1) for b in held])
        lengths = np.concatenate([b.column(2).to_numpy() for b in held])
        d, s, n = pack(pc.fill_null(ids, 0).to_numpy(), lengths, capacity)
        ends = np.cumsum([0, *(len(x) for x in d)]).astype(np.int32)
        doc_ids = pa.ListArray.from_arrays(pa.array(ends), ids.take(pa.array([i for x in d for i in x], pa.int64())))
        return T.batch(_BINS, bin_id=(shard << 32) + np.arange(len(d), dtype=np.int64), n_tokens=[sum(x) for x in n], doc_ids=doc_ids, starts=s, lengths=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            shard = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if now is not None and now != shard[x]:
                    yield packed(now, held)
                    held = []
                now = int(shard[x])
                held.append(b.slice(x, y - x))
        if now is not None:
            yield packed(now, held)

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin_id, n_tokens, doc_ids, starts, lengths): the training sequences, with their pieces' documents and token spans.

    Every token of every row is in exactly one bin; no bin exceeds ``capacity``. Null, empty and blank texts have no tokens
    and are in no bin; a row without an id is packed as any other, with a null in ``doc_ids``. Repeated rows are packed each.
    Other columns are not read. An empty table gives no bins.
    """
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col(text_col).cast("string")))).first()
    shards = max(1, min(-(-count // shard_docs), -(-(size or 0) // shard_bytes)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lengths = rows.mapInArrow(_lengths(tokenizer_path), ddl(_LENGTHS)).where("n_tokens > 0")
    dealt = lengths.select(F.pmod(F.xxhash64("deal"), F.lit(shards)).alias("shard"), "doc_id", "n_tokens").repartition("shard").sortWithinPartitions("shard", "doc_id", "n_tokens")
    return dealt.mapInArrow(_shards(capacity), "bin_id long, n_tokens long, doc_ids array<long>, starts array<long>, lengths array<long>")
