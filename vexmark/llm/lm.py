"""Language-model scoring by a hashed maximum-entropy model: a class-factored softmax, and sparse n-gram weights over it.

*Vocabulary.* Words are lower-cased runs of letters, digits and multi-byte characters, hashed into buckets that are counted
over all documents; there are as many buckets as the corpus has words to the power of 0.75, 65,536 at least and 4 million at
most. The 4,032 most frequent buckets are words of the softmax, 64 to a class in order of frequency; all others share the 64
words of a last class by hash, and each has its part of such a word by its count.

*Softmax.* log p(class | history) + log p(word | class, history) + log p(bucket | word). Features of a history are the last
word and, as a skip, the last but one; beside a constant. Each picks, by hash, a row of 64 weights for the classes, and
together with the class a row of 64 weights for its words. A softmax thus costs 128 sums instead of 4,096. The constant's
weights start at the corpus counts. Then, in ``rounds`` rounds of one part of the documents' blocks each, every task takes
its blocks through minibatches of gradient steps (AdaGrad per row) from the shared weights, and sends the rows it moved with
how often each was used; rows are averaged over tasks by that use in a shuffle. The softmax's size is fixed, 11 MB, and so is
what is broadcast, with ten bytes a bucket 53 MB at most.

*Sparse weights.* Every pair of a context (the two words before, as they are) and a bucket that occurs in two rows or more is a
feature with a weight of its own; there are as many as the corpus has, and 16 million slots for the contexts of each group
of two million words. p(bucket | context) is the softmax's times e^weight, over
the context's sum. Words go to groups by hash of their context, seven bytes each, so a group holds all of a context's words,
and its weights come from Newton's gradient steps under a Gaussian prior without any exchange with others; what a group adds
to each row's log-probability goes back in a second shuffle. A context that would fill a quarter of a group is dealt into
parts by row, each with weights of its own.

*Scoring.* Rows of weights are gathered for batches of words, and documents get the sum over all their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T
from .line_dedup import ddl

BUCKETS, MOST_BUCKETS, WIDTH = 1 << 16, 1 << 22, 64
VOCABULARY = WIDTH * WIDTH
CLASS_ROWS, WORD_ROWS = 1 << 13, 1 << 15
TOKENS, RATE, ROUNDS, SHORT = 4096, 0.15, 2, 8
GROUP, GROUPS, HELD, PART, HOT = 1 << 21, 1 << 16, 1 << 21, 1 << 22, 1 << 17
PRIOR, STEPS, FINE, SLOTS = 0.3, 14, 64, 1 << 24
BOS = VOCABULARY
F32 = np.float32
_COUNTS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])
_MOVED = pa.schema([("row", pa.int32()), ("used", pa.int64()), ("weights", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_prob", pa.float64()), ("perplexity", pa.float64())])
_SPREAD = pa.schema([("grp", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_prob", pa.float64()), ("payload", pa.binary())])
_ADDED = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_prob", pa.float64())])


@dataclass
class Model:
    """``number``: the softmax's word of each bucket, ``rank``: its place by count, ``within``: its log-share of the word; ``weights``: class rows (the first is
    the constant's), then word rows (the first 64 are the constant's). ``hot``: contexts dealt into parts, and into how many; ``groups``."""

    number: np.ndarray
    rank: np.ndarray
    within: np.ndarray
    weights: np.ndarray
    hot: tuple[np.ndarray, np.ndarray] = (np.zeros(0, T.U64), np.zeros(0, np.int64))
    groups: int = 1


def fresh(counts: np.ndarray) -> Model:
    """The unigram model of the buckets' counts."""
    order = np.argsort(-counts, kind="stable")
    number = (VOCABULARY - WIDTH + np.arange(len(counts)) % WIDTH).astype(np.uint16)
    number[order[: VOCABULARY - WIDTH]] = np.arange(VOCABULARY - WIDTH)
    sizes = np.bincount(number, counts + 0.5, VOCABULARY)
    mass = np.bincount(number, counts, VOCABULARY).reshape(WIDTH, WIDTH) + 0.5
    weights = np.zeros((CLASS_ROWS + WORD_ROWS, WIDTH), F32)
    weights[0] = np.log(mass.sum(axis=1) / mass.sum())
    weights[CLASS_ROWS : CLASS_ROWS + WIDTH] = np.log(mass / mass.sum(axis=1, keepdims=True))
    rank = np.empty(len(counts), np.uint32)
    rank[order] = np.arange(len(counts))
    return Model(number, rank, np.log((counts + 0.5) / sizes[number]).astype(F32), weights)


def shifted(w: np.ndarray, before: np.ndarray, bos: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each, and the one before that; ``bos`` at a row's start."""
    one, two = np.full(len(w), bos, w.dtype), np.full(len(w), bos, w.dtype)
    one[1:], two[2:] = w[:-1], w[:-2]
    first = before[:-1][np.diff(before) > 0]
    one[first] = two[first] = bos
    two[first[np.diff(before)[np.diff(before) > 0] > 1] + 1] = bos
    return one, two


def words(model: Model, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(words before each row, hash, bucket, word, the word before, the one before that)."""
    _, _, before, h = T.word_hashes(buf, off)
    bucket = (h & T.U64(len(model.number) - 1)).astype(np.int64)
    w = model.number[bucket].astype(np.uint32)
    return before, h, bucket, w, *shifted(w, before, BOS)


def contexts(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hash of the two words before each."""
    one, two = shifted(h, before, 0)
    return T.mix(one * T.U64(0x9E3779B97F4A7C15) + T.mix(two + T.U64(1)))


def _hashed(x: np.ndarray, salt: int, low: int, high: int) -> np.ndarray:
    """Rows of [low, high) by a multiplicative hash."""
    h = (x + np.uint32(salt)) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    h ^= h >> np.uint32(13)
    return (low + h % np.uint32(high - low)).astype(np.int32)


def rows(w: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each feature's class row, and its word row (counted from the first word row)."""
    cls = w // np.uint32(WIDTH)
    of_class = [_hashed(f, s, 1, CLASS_ROWS) for f, s in ((one, 1), (two, 70001))]
    of_word = [_hashed(f * np.uint32(61) + cls, s, WIDTH, WORD_ROWS) for f, s in ((one, 3), (two, 900001))]
    return of_class, of_word


class Softmax:
    """Batches of at most TOKENS rows of one level's weights, in buffers that are used again."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.z, self.part = np.empty((TOKENS, WIDTH), F32), np.empty((TOKENS, WIDTH), F32)
        self.ones, self.at = np.ones(WIDTH, F32), np.arange(TOKENS)

    def run(self, constant: np.ndarray, feats: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(exponentials, their sums, log-probability of the target)."""
        n = len(target)
        z, part, at = self.z[:n], self.part[:n], self.at[:n]
        np.take(self.weights, constant, axis=0, out=z, mode="clip")
        for f in feats:
            np.take(self.weights, f, axis=0, out=part, mode="clip")
            z += part
        np.clip(z, -60, 60, out=z)  # far beyond what training reaches; keeps the sums finite
        hit = z[at, target]
        np.exp(z, out=z)
        total = z @ self.ones
        return z, total, hit - np.log(total)


def log_probs(model: Model, w: np.ndarray, one: np.ndarray, two: np.ndarray, levels: tuple[Softmax, Softmax] | None = None) -> np.ndarray:
    classes, members = levels or (Softmax(model.weights[:CLASS_ROWS]), Softmax(model.weights[CLASS_ROWS:]))
    out = np.empty(len(w))
    of_class, of_word = rows(w, one, two)
    c, k = (w // WIDTH).astype(np.int64), (w % WIDTH).astype(np.int64)
    constant = np.zeros(TOKENS, np.int64)
    for i in range(0, len(w), TOKENS):
        s = slice(i, i + TOKENS)
        out[s] = classes.run(constant[: len(c[s])], [f[s] for f in of_class], c[s])[2]
        out[s] += members.run(c[s], [f[s] for f in of_word], k[s])[2]
    return out


class Trainer:
    """Gradient steps of one task, from the shared weights."""

    def __init__(self, model: Model) -> None:
        self.weights = model.weights.copy()
        self.squares = np.full(len(self.weights), 1e-6, F32)
        self.used = np.zeros(len(self.weights), np.int64)
        self.levels = [(Softmax(self.weights[slice(*r)]), self.squares[slice(*r)]) for r in ((0, CLASS_ROWS), (CLASS_ROWS, CLASS_ROWS + WORD_ROWS))]
        self.part = np.empty((TOKENS, WIDTH), F32)

    def _move(self, level: tuple, row: np.ndarray, total: np.ndarray) -> None:
        """Move rows by their gradients over the root of their squares so far."""
        soft, squares = level
        so_far = squares[row]
        so_far += np.einsum("ij,ij->i", total, total) / WIDTH
        squares[row] = so_far
        total *= (-RATE / np.sqrt(so_far))[:, None]
        np.take(soft.weights, row, axis=0, out=(old := self.part[: len(row)]), mode="clip")
        total += old
        soft.weights[row] = total

    def _sums(self, g: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sums of g's rows over the runs of ``order``: place by place for short runs, by eights for the rest of long ones."""
        n = len(order)
        if len(first) == 1:
            return (np.ones(n, F32) @ g)[None, :]
        total = np.take(g, order[first], axis=0)
        live, d = np.flatnonzero(size > 1), 1
        while len(live) and d < SHORT:
            total[live] += np.take(g, order[first[live] + d], axis=0)
            d += 1
            live = live[size[live] > d]
        if len(live):  # what is left of long runs, eight at a time; zeros fill up the last eight
            rest = size[live] - d
            eights = -(-rest // 8)
            run = np.repeat(np.arange(len(live)), eights)
            begin = 8 * (np.arange(len(run)) - np.repeat(np.cumsum(eights) - eights, eights))
            place = begin[:, None] + np.arange(8)
            inside = place < rest[run][:, None]
            at = np.where(inside, order[np.minimum((first[live] + d)[run][:, None] + place, n - 1)], 0)
            parts = np.take(g, at.ravel(), axis=0).reshape(len(run), 8, WIDTH)
            parts[~inside] = 0
            parts = np.matmul(np.ones((1, 8), F32), parts)[:, 0]
            total[live] += np.add.reduceat(parts, np.cumsum(eights) - eights, axis=0)
        return total

    def step(self, c: np.ndarray, k: np.ndarray, of_class: list[np.ndarray], of_word: list[np.ndarray]) -> None:
        n = len(c)
        at = np.arange(n)
        for level, constant, feats, target in zip(self.levels, (np.zeros(n, np.int64), c), (of_class, of_word), (c, k), strict=True):
            g, sums, _ = level[0].run(constant, feats, target)
            g *= (1 / sums)[:, None]
            g[at, target] -= 1
            for f in (constant, *feats):
                order = np.argsort(f.astype(np.uint16), kind="stable")
                row = f[order]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                size = np.diff(first, append=n)
                self._move(level, row[first], self._sums(g, order, first, size))

    def block(self, model: Model, buf: np.ndarray, off: np.ndarray) -> None:
        *_, w, one, two = words(model, buf, off)
        of_class, of_word = rows(w, one, two)
        c, k = (w // WIDTH).astype(np.int64), (w % WIDTH).astype(np.int64)
        self.used[0] += len(w)
        for f, low in ((c, CLASS_ROWS), *((f, 0) for f in of_class), *((f, CLASS_ROWS) for f in of_word)):
            n = np.bincount(f)
            self.used[low : low + len(n)] += n
        for i in range(0, len(w), TOKENS):
            s = slice(i, i + TOKENS)
            self.step(c[s], k[s], [f[s] for f in of_class], [f[s] for f in of_word])

    def moved(self) -> Iterator[pa.RecordBatch]:
        row = np.flatnonzero(self.used)
        for i in range(0, len(row), 5000):
            r = row[i : i + 5000]
            data = self.weights[r].astype(np.float16)
            ends = (np.arange(len(r) + 1) * data.itemsize * WIDTH).astype(np.int32)
            yield T.batch(_MOVED, row=r.astype(np.int32), used=self.used[r], weights=pa.BinaryArray.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]))


def _vectors(col: pa.Array) -> np.ndarray:
    size = WIDTH * 2
    return np.frombuffer(col.buffers()[2], np.uint8)[: (col.offset + len(col)) * size][col.offset * size :].view(np.float16).reshape(-1, WIDTH).astype(F32)


def _count(buckets: int, parts: int):
    """Words by bucket, and contexts that have more than about one in 2 * ``parts`` of a task's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, total = np.zeros(buckets, np.int64), [], 0
        for b in batches:
            for _, _, buf, off in T.text_blocks(b.column(0)):
                _, _, before, h = T.word_hashes(buf, off)
                n += np.bincount((h & T.U64(buckets - 1)).astype(np.int64), minlength=buckets)
                ctx, least = contexts(h, before), max(2, len(h) // (4 * parts))
                slot = (ctx & T.U64(0xFFFF)).astype(np.int64)  # few slots have as many, so few contexts are sorted
                u, k = np.unique(ctx[np.bincount(slot, minlength=1 << 16)[slot] >= least], return_counts=True)
                total += len(h)
                held.append((u[k >= least], k[k >= least]))
                if len(held) == 64:
                    held = [_merged(held, total // (4 * parts))]
        some = np.flatnonzero(n)
        yield T.batch(_COUNTS, kind=np.zeros(len(some), np.int32), key=some, n=n[some])
        u, k = _merged(held, total // (4 * parts))
        yield T.batch(_COUNTS, kind=np.ones(len(u), np.int32), key=T.signed(u), n=k)

    return run


def _merged(held: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts summed by context, of those with ``least`` or more."""
    if not held:
        return np.zeros(0, T.U64), np.zeros(0, np.int64)
    u, inv = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    k = np.bincount(inv, np.concatenate([n for _, n in held]), len(u)).astype(np.int64)
    return u[k >= least], k[k >= least]


def _train(shared, turn: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        trainer, k = Trainer(model), TaskContext.get().partitionId()
        for b in batches:
            for _, _, buf, off in T.text_blocks(b.column(0)):
                if k % rounds == turn:
                    trainer.block(model, buf, off)
                k += 1
        yield from trainer.moved()

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition averaged by use; a partition has all occurrences of its rows."""
    n = CLASS_ROWS + WORD_ROWS
    used, total = np.zeros(n, np.int64), np.zeros((n, WIDTH), F32)
    for b in batches:
        row, u = b.column(0).to_numpy(), b.column(1).to_numpy()
        v = _vectors(b.column(2))
        r, k, x = _grouped(row, u, v)
        used[r] += k
        total[r] += (x - total[r]) * (k / used[r])[:, None].astype(F32)  # running means stay within single precision
    row = np.flatnonzero(used)
    for i in range(0, len(row), 5000):
        r = row[i : i + 5000]
        yield T.batch(_MOVED, row=r.astype(np.int32), used=used[r], weights=[x.tobytes() for x in total[r].astype(np.float16)])


def _grouped(row: np.ndarray, used: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(row, kind="stable")
    first = np.flatnonzero(np.diff(row[order], prepend=-1))
    k = np.add.reduceat(used[order], first)
    return row[order][first], k, np.add.reduceat(v[order] * used[order][:, None], first, axis=0) / k[:, None]


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, group: int = GROUP) -> Model:
    """A softmax of all of the documents' words, and how to deal their contexts."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(MOST_BUCKETS, max(BUCKETS, 2 ** np.ceil(np.log2(max(size / 4, 1) ** 0.75)))))
    parts = int(min(HOT, max(1, -(-size // group))))  # a word has four bytes or so, and a fourth of a group is too much
    counted = texts.mapInArrow(_count(buckets, parts), ddl(_COUNTS)).groupBy("kind", "key").agg(F.sum("n").alias("n")).where(f"kind = 0 OR n > {group // 4}").toArrow()
    kind, key, n = (counted.column(c).to_numpy() for c in ("kind", "key", "n"))
    counts = np.zeros(buckets, np.int64)
    counts[key[kind == 0]] = n[kind == 0]
    model = fresh(counts)
    hot = key[kind == 1].view(T.U64)
    order = np.argsort(hot)
    model.hot = hot[order], -(-n[kind == 1][order] // (group // 4))
    model.groups = int(min(GROUPS, max(1, -(-counts.sum() // group))))
    for turn in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        moved = texts.mapInArrow(_train(shared, turn, rounds), ddl(_MOVED)).repartition("row").mapInArrow(_average, ddl(_MOVED))
        rows_ = moved.toArrow().combine_chunks()
        weights = model.weights.copy()
        for b in rows_.to_batches():
            weights[b.column(0).to_numpy()] = _vectors(b.column(2))
        model = Model(model.number, model.rank, model.within, weights, model.hot, model.groups)
        shared.unpersist()
    return model


def _levels(model: Model) -> tuple[Softmax, Softmax]:
    return Softmax(model.weights[:CLASS_ROWS]), Softmax(model.weights[CLASS_ROWS:])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        levels = _levels(model)
        for b in batches:
            for i, j, buf, off in T.text_blocks(b.column(1)):
                before, _, bucket, w, one, two = words(model, buf, off)
                sums = np.concatenate([[0], np.cumsum(log_probs(model, w, one, two, levels) + model.within[bucket])])
                total, n = np.diff(sums[before]), np.diff(before)
                some = n > 0
                yield T.batch(_SCORES, doc_id=b.column(0).slice(i, j - i), n_words=n, log_prob=np.where(some, total, 0.0), perplexity=pa.array(np.exp(-total / np.maximum(n, 1)), mask=~some))

    return run


# -- sparse weights ----------------------------------------------------------------------------------------------------


def weights(count: np.ndarray, p: np.ndarray, owner: np.ndarray, total: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(each feature's weight, each context's log-sum): features occur ``count`` times of their ``owner`` context's ``total``.

    The most likely weights under a Gaussian prior of precision PRIOR, with ``p`` the softmax's probability of a feature's bucket;
    each step goes by the gradient over a bound of the curvature.
    """
    theta = np.zeros(len(p))
    n = total[owner]
    for _ in range(steps):
        e = p * np.exp(theta)
        z = np.maximum(1 + np.bincount(owner, e - p, len(total)), 1e-9)
        expected = n * e / z[owner]
        theta += np.clip((count - expected - PRIOR * theta) / (expected + PRIOR), -2, 2)
    return theta, np.log(np.maximum(1 + np.bincount(owner, p * np.expm1(theta), len(total)), 1e-9))


def added(ctx: np.ndarray, bucket: np.ndarray, fine: np.ndarray, row: np.ndarray) -> np.ndarray:
    """What the sparse weights of these words add to each one's log-probability; they hold all words of their contexts.

    ``fine`` is the softmax's -log p in parts of FINE, ``row`` tells the rows apart.
    """
    key = (ctx.astype(T.U64) << T.U64(22)) | bucket.astype(T.U64)
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key))
    if not len(key):
        return out
    sorted_, r = key[order], row[order]
    pair = np.flatnonzero(np.diff(sorted_, prepend=~sorted_[:1]))
    n = np.diff(pair, append=len(key))
    shared = np.minimum.reduceat(r, pair) != np.maximum.reduceat(r, pair)
    of_pair = sorted_[pair] >> T.U64(22)
    first = np.flatnonzero(np.diff(of_pair, prepend=~of_pair[:1]))
    context = np.repeat(np.arange(len(first)), np.diff(first, append=len(pair)))
    feature = np.flatnonzero(shared)
    if not len(feature):
        return out
    some, owner = np.unique(context[feature], return_inverse=True)
    p = np.exp(-fine[order[pair[feature]]].astype(np.float64) / FINE)
    theta, log_z = weights(n[feature], p, owner, np.add.reduceat(n, first)[some].astype(np.float64))
    per_context, per_pair = np.zeros(len(first)), np.zeros(len(pair))
    per_context[some] = log_z
    per_pair[feature] = theta
    out[order] = np.repeat(per_pair - per_context[context], n)
    return out


_PLANES = (3, 3, 2)  # bytes of a context's slot, a bucket's rank and -log p


def _packed(ctx: np.ndarray, bucket: np.ndarray, fine: np.ndarray, row: np.ndarray) -> bytes:
    """Words by byte planes, compressed; and the runs of words of one row."""
    begin = np.flatnonzero(np.diff(row, prepend=~row[:1]))
    size = np.diff(begin, append=len(row))
    planes = [x.astype("<u4").view(np.uint8).reshape(-1, 4).T[:k].tobytes() for x, k in zip((ctx, bucket, fine, size), (*_PLANES, 4), strict=True)]
    return np.array([len(ctx), len(begin)], np.int64).tobytes() + pa.compress(b"".join([*planes, row[begin].tobytes()]), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, runs = np.frombuffer(data, np.int64, 2).tolist()
    raw = np.frombuffer(pa.decompress(data[16:], sum(_PLANES) * n + 12 * runs, "zstd"), np.uint8)
    out, at = [], 0
    for k, m in zip((*_PLANES, 4), (n, n, n, runs), strict=True):
        wide = np.zeros((m, 4), np.uint8)
        wide[:, :k] = raw[at : at + k * m].reshape(k, m).T
        out.append(wide.view("<u4").ravel())
        at += k * m
    return out[0], out[1], out[2], np.repeat(raw[at:].view(np.int64), out[3])


def _spread(shared):
    """Rows with the softmax's log-probability, and their words by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        levels, (hot, parts) = _levels(model), model.hot
        seen: dict[int, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        partition = T.U64(TaskContext.get().partitionId() + 1)

        def flush() -> pa.RecordBatch:
            group, *cols = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(group.astype(np.uint16), kind="stable")
            group, cols = group[order], [c[order] for c in cols]
            cut = np.flatnonzero(np.diff(group, prepend=-1))
            ends = np.append(cut[1:], len(group))
            k = len(cut)
            none = pa.nulls(k, pa.int64())
            return T.batch(_SPREAD, grp=group[cut], key=none, doc_id=none, n_words=ends - cut, log_prob=pa.nulls(k, pa.float64()), payload=[_packed(*(c[i:j] for c in cols)) for i, j in zip(cut, ends, strict=True)])

        for b in batches:
            ids = b.column(0)
            for i, j, buf, off in T.text_blocks(b.column(1)):
                before, h, bucket, w, one, two = words(model, buf, off)
                logp = log_probs(model, w, one, two, levels) + model.within[bucket]
                # a row's key: of its id and text, which of the task's rows like it, and the task, so that a task run again gives the same
                content = T.mix(T.span_hash(T.prefix_hash(buf), off[:-1], off[1:]) ^ T.mix(_id_bits(ids.slice(i, j - i))))
                nth = np.zeros(j - i, T.U64)
                for k, c in enumerate(content.tolist()):
                    nth[k] = seen[c] = seen.get(c, 0) + 1
                key = T.signed(T.mix(content ^ T.mix(nth * T.U64(0xA24BAED4963EE407) + partition)))
                ctx, row = contexts(h, before), key[T.rows_of(before)]
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, ctx), len(hot) - 1)
                    deal = np.where(hot[at] == ctx, row.view(T.U64) % parts[at].astype(T.U64), 0)
                    ctx = np.where(deal > 0, T.mix(ctx + deal), ctx)
                group = ((ctx >> T.U64(32)) % T.U64(model.groups)).astype(np.int64)
                held.append((group, (ctx & T.U64(SLOTS - 1)).astype(np.uint32), model.rank[bucket], np.rint(np.minimum(-logp * FINE, 65535)).astype(np.uint32), row))
                total = np.diff(np.concatenate([[0], np.cumsum(logp)])[before])
                yield T.batch(_SPREAD, grp=-1 - (key & 0xFFFF), key=key, doc_id=ids.slice(i, j - i), n_words=np.diff(before), log_prob=total, payload=pa.nulls(j - i, pa.binary()))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield flush()
                    held = []
        if any(len(x[0]) for x in held):
            yield flush()

    return run


def _id_bits(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(0).to_numpy().view(T.U64)


def _group_sums(payloads: list[bytes]) -> pa.RecordBatch:
    """What one group adds to its rows; a large group goes by parts of its contexts."""
    size = sum(int(np.frombuffer(p, np.int64, 1)[0]) for p in payloads)
    parts = -(-size // PART)
    keys, sums = [], []
    for part in range(parts):
        got = [_unpacked(p) for p in payloads]
        if parts > 1:
            got = [tuple(c[mine] for c in g) for g in got for mine in [g[0] % np.uint32(parts) == part]]
        ctx, bucket, fine, row = (np.concatenate(c) for c in zip(*got, strict=True))
        more = added(ctx, bucket, fine, row)
        u, at = np.unique(row[more != 0], return_inverse=True)
        keys.append(u)
        sums.append(np.bincount(at, more[more != 0], len(u)))
    key = np.concatenate(keys)
    none = pa.nulls(len(key), pa.int64())
    return T.batch(_ADDED, key=key, doc_id=none, n_words=none, log_prob=np.concatenate(sums))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as they are, and what each group adds to them; groups come whole and one after the other."""
    now, held = None, []
    for b in batches:
        grp = b.column(0).to_numpy()
        rows_ = b.filter(pa.array(grp < 0))
        if rows_.num_rows:
            yield T.batch(_ADDED, **{c: rows_.column(rows_.schema.get_field_index(c)) for c in ("key", "doc_id", "n_words", "log_prob")})
        for k in np.flatnonzero(grp >= 0):
            if held and grp[k] != now:
                yield _group_sums(held)
                held = []
            now = grp[k]
            held.append(b.column(5)[int(k)].as_py())
    if held:
        yield _group_sums(held)


def score(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every row, by a model trained on all rows; if one is given, by its softmax alone.

    A text that is null, empty or without words has 0 words, log-probability 0 and a null perplexity. Repeated rows and null
    ids are rows of the result, and count as rows in which a feature occurs. Other columns are not read. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is not None:
        return rows_.mapInArrow(_score(spark.sparkContext.broadcast(model)), ddl(_SCORES))
    shared = spark.sparkContext.broadcast(train(docs, text_col, rounds, group))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = rows_.mapInArrow(_spread(shared), ddl(_SPREAD)).repartitionById(tasks, F.pmod("grp", F.lit(tasks)).cast("int")).sortWithinPartitions("grp")
    sums = spread.mapInArrow(_add, ddl(_ADDED)).groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("log_prob").alias("log_prob"))
    return sums.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.exp(-F.col("log_prob") / F.col("n_words"))).alias("perplexity"))
