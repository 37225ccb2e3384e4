"""Language identification by a bidirectional gated recurrent network over bytes.

*Network.* A text is read in windows of 64 bytes (the last one shorter), each from a zero state and in both directions by
gated recurrent units of 8 cells. At every position the two states give probabilities of the languages, so each byte of
each text is labelled; a document's probabilities are the normalised exponentials of its positions' mean log-probabilities.
Input projections are rows of a table by byte (ASCII letters in lower case), and a padding symbol keeps the state at zero.

*Training.* Backpropagation through time in numpy with Adam on the driver, from windows drawn evenly over whole texts of at
most ``max_labelled`` documents that have a language, those with the smallest hashes of doc_id, each language weighing the
same. That sample is the only bounded part.

*Inference.* A block's windows run side by side: a step is three gathers, three small products and a few elementwise passes
over thousands of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T

MAX_LABELLED, WINDOW, CELLS, STEPS, BATCH, RATE, SIDE = 2_000, 64, 8, 300, 256, 0.02, 2048
PAD = 256
F32 = np.float32


@dataclass
class Network:
    """Weights by gate (reset, update, new): inputs (gate, direction, symbol, cell), recurrence (gate, direction, cell, cell)."""

    classes: list[str]
    inputs: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, classes: list[str], cells: int = CELLS, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        net = cls(classes, rng.normal(0, 0.3, (3, 2, 257, cells)).astype(F32), rng.normal(0, 1 / np.sqrt(cells), (3, 2, cells, cells)).astype(F32), rng.normal(0, 0.3, (2 * cells, len(classes))).astype(F32), np.zeros(len(classes), F32))
        net._pin()
        return net

    def _pin(self) -> None:
        self.inputs[:, :, PAD] = 0
        self.inputs[1, :, PAD] = 30  # the update gate holds the zero state

    def params(self) -> list[np.ndarray]:
        return [self.inputs, self.recur, self.out, self.bias]


def windows(buf: np.ndarray, off: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(row of each window, its start); windows cover every byte once."""
    n = -(-np.diff(off) // width)
    row = np.repeat(np.arange(len(n)), n)
    return row, off[row] + width * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))


def symbols(buf: np.ndarray, start: np.ndarray, end: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """(step, window) of symbols, padded."""
    at = start[None, :] + np.arange(width)[:, None]
    return np.where(at < end[None, :], T.LOWER[buf[np.minimum(at, max(len(buf) - 1, 0))]].astype(np.int32), PAD)


def states(net: Network, sym: np.ndarray, keep: bool = False) -> tuple[np.ndarray, ...]:
    """(step, direction, window, cell) of states; the second direction's steps run from the end. ``keep``: and the gates."""
    steps, n = sym.shape
    cells = net.recur.shape[-1]
    half = np.array([0.5, 0.5, 1], F32)[:, None, None, None]  # a sigmoid is a shifted tanh of half its argument
    table, recur = (net.inputs * half).reshape(3, 2 * 257, cells), net.recur * half
    idx = np.concatenate([sym, sym[::-1] + 257], axis=1)
    shape = (2, n, cells)
    h = np.zeros((steps + 1, *shape), F32)
    x, u, v = np.empty(shape, F32), np.empty(shape, F32), np.empty(shape, F32)
    r, z = np.empty(shape, F32), np.empty(shape, F32)
    gates = np.empty((steps, 4, *shape), F32) if keep else None
    flat = (2 * n, cells)
    for t in range(steps):
        i, p = idx[t], h[t]
        for gate, to in ((0, r), (1, z)):
            np.take(table[gate], i, axis=0, out=to.reshape(flat), mode="clip")
            np.matmul(p, recur[gate], out=u)
            to += u
            np.tanh(to, out=to)
            to += 1
            to *= 0.5
        np.take(table[2], i, axis=0, out=x.reshape(flat), mode="clip")
        np.matmul(p, recur[2], out=u)
        np.multiply(r, u, out=v)
        x += v
        np.tanh(x, out=x)
        if keep:
            gates[t, 0], gates[t, 1], gates[t, 2], gates[t, 3] = r, z, x, u
        np.subtract(p, x, out=v)
        v *= z
        np.add(v, x, out=h[t + 1])
    return (h, gates) if keep else (h,)


def positions(net: Network, h: np.ndarray) -> np.ndarray:
    """(step, window, class) of log-probabilities."""
    cells = net.recur.shape[-1]
    fwd, bwd = h[1:, 0], h[:0:-1, 1]
    z = fwd @ net.out[:cells] + bwd @ net.out[cells:]
    z += net.bias
    z -= z.max(axis=-1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=-1, keepdims=True))
    return z


def gradients(net: Network, sym: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted mean cross-entropy over the positions, and its gradients by backpropagation through time."""
    steps, n = sym.shape
    cells = net.recur.shape[-1]
    h, gates = states(net, sym, keep=True)
    logp = positions(net, h)
    real = (sym != PAD) * weight[None, :]
    total = max(real.sum(), 1e-9)
    loss = -(np.take_along_axis(logp, np.broadcast_to(label[None, :, None], (steps, n, 1)), axis=2)[..., 0] * real).sum() / total
    dz = np.exp(logp)
    dz[:, np.arange(n), label] -= 1
    dz *= (real / total)[..., None].astype(F32)
    fwd, bwd = h[1:, 0], h[:0:-1, 1]
    d_out = np.concatenate([fwd.reshape(-1, cells).T, bwd.reshape(-1, cells).T]) @ dz.reshape(-1, dz.shape[-1])
    d_bias = dz.sum(axis=(0, 1))
    dh_out = np.stack([dz @ net.out[:cells].T, (dz @ net.out[cells:].T)[::-1]], axis=1)
    d_in = np.zeros((3, 2 * 257, cells), F32)
    d_rec = np.zeros_like(net.recur)
    idx = np.concatenate([sym, sym[::-1] + 257], axis=1)
    dh = np.zeros((2, n, cells), F32)
    for t in range(steps - 1, -1, -1):
        r, z, x, u = gates[t]
        p = h[t]
        dh = dh + dh_out[t]
        dx = dh * (1 - z) * (1 - x * x)
        dzg = dh * (p - x) * z * (1 - z)
        dr = dx * u * r * (1 - r)
        du = dx * r
        dh = dh * z
        for gate, (inp, rec) in enumerate(((dr, dr), (dzg, dzg), (dx, du))):
            np.add.at(d_in[gate], idx[t], inp.reshape(2 * n, cells))
            d_rec[gate] += p.transpose(0, 2, 1) @ rec
            dh = dh + rec @ net.recur[gate].transpose(0, 2, 1)
    return float(loss), [d_in.reshape(net.inputs.shape), d_rec, d_out, d_bias]


def fit(texts: pa.Array, langs: list[str], steps: int = STEPS, seed: int = 11) -> Network:
    """Adam over batches of windows; each language is drawn as often."""
    classes = sorted(set(langs))
    net = Network.fresh(classes)
    buf, off = T.utf8(texts)
    row, start = windows(buf, off)
    if len(classes) < 2 or not len(row):
        return net
    label = np.array([classes.index(x) for x in langs])[row]
    rng = np.random.default_rng(seed)
    pools = [p for c in range(len(classes)) if len(p := np.flatnonzero(label == c))]
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(p, BATCH // len(pools)) for p in pools])
        sym = symbols(buf, start[pick], np.minimum(start[pick] + WINDOW, off[row[pick] + 1]))
        _, grads = gradients(net, sym, label[pick], np.ones(len(pick), F32))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1, 2 * (1 - t / (steps + 1))) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        for p, g, a, b in zip(net.params(), grads, m, v, strict=True):
            g = g * F32(min(1, 1 / max(norm, 1e-9)))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * a / (np.sqrt(b) + 1e-8)).astype(F32)
        net._pin()
    return net


def label_block(net: Network, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, class): mean log-probability of the row's positions; and how many positions each class labels."""
    n, c = len(off) - 1, len(net.classes)
    logp, labelled = np.zeros((n, c)), np.zeros((n, c), np.int64)
    row, start = windows(buf, off)
    for i in range(0, len(row), SIDE):
        r, s = row[i : i + SIDE], start[i : i + SIDE]
        sym = symbols(buf, s, np.minimum(s + WINDOW, off[r + 1]))
        z = positions(net, *states(net, sym))
        real = sym != PAD
        z *= real[..., None]
        best = np.where(real, z.argmax(axis=-1), c)
        per = z.sum(axis=0)
        for k in range(c):
            logp[:, k] += np.bincount(r, per[:, k], n)
            labelled[:, k] += np.bincount(r, (best == k).sum(axis=0), n).astype(np.int64)
    return logp / np.maximum(np.diff(off), 1)[:, None], labelled


def _identify(shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        names = np.array(net.classes, object)
        for b in batches:
            for i, j, buf, off in T.text_blocks(b.column(1)):
                logp, labelled = label_block(net, buf, off)
                p = np.exp(logp - logp.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                some = np.diff(off) > 0
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array(names[best], pa.string(), mask=~some), pa.array(p[np.arange(j - i), best], mask=~some),
                    *(pa.array(labelled[:, k]) for k in range(len(names)))], schema=schema)

    return run


def train(docs: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("long").alias("__g_id"))
    picked = known.distinct().orderBy(F.xxhash64("__g_id"), "__g_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("__d_id"), F.col(text_col).cast("string").alias("__d_text"), F.col(lang_col).cast("string").alias("__d_lang"))
    got = rows.join(F.broadcast(picked), F.col("__d_id") == F.col("__g_id")).where("__d_lang IS NOT NULL")
    one = got.groupBy("__d_id").agg(F.min(F.struct("__d_lang", "__d_text")).alias("d")).select("__d_id", "d.*")  # rows may repeat an id
    table = one.toArrow().sort_by("__d_id")
    return fit(pa.array(table.column("__d_text").to_pylist(), pa.large_string()), table.column("__d_lang").to_pylist())


def identify(docs: DataFrame, network: Network | None = None, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, probability, bytes_<language>...): each row's language and how many of its bytes have each label.

    Null and empty texts have a null language and no labelled bytes; of equal probabilities the first language in
    alphabetical order wins. Repeated rows and null ids are rows of the result. Other columns are not read. If no row has a
    language there is nothing to learn from, and every result is null. An empty table gives an empty result.
    """
    net = network or train(docs, max_labelled, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not net.classes:
        return rows.select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    counts = [f"bytes_{c}" for c in net.classes]
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("probability", pa.float64()), *((c, pa.int64()) for c in counts)])
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return rows.mapInArrow(_identify(shared, schema), "doc_id long, lang string, probability double, " + ", ".join(f"`{c}` long" for c in counts))
