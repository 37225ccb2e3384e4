"""Text embedding: pooled, normalised vectors from a pluggable model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import EMBEDDING_DIMENSION

DIRECTIONS = 1 << 14
_WORD = re.compile(r"\w+")


class Embedder(Protocol):
    """A model: texts in, one row of ``EMBEDDING_DIMENSION`` floats each out. It is pickled to the workers and loaded there."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(text, token, value) and (text, token) to (text, value): the mean over unmasked tokens, zeros if all are masked."""
    m = mask.astype(np.float32)[:, :, None]
    n = m.sum(axis=1)
    return np.where(n > 0, (tokens * m).sum(axis=1) / np.maximum(n, 1), 0).astype(np.float32)


def normalize(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of almost no length as they are."""
    n = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.where(n > 1e-12, x / np.maximum(n, 1e-12), x).astype(np.float32)


@lru_cache(maxsize=4)
def _directions(dimensions: int) -> np.ndarray:
    return np.random.default_rng(11).normal(size=(DIRECTIONS, dimensions)).astype(np.float32)


class HashingEmbedder:
    """A deterministic model that needs no files: a word's hash picks a direction and its sign, a text is the mean of its words'."""

    def __init__(self, dimensions: int = EMBEDDING_DIMENSION) -> None:
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Distinct words of all texts are hashed once, and texts are sums over them by a product of a sparse table."""
        found = [_WORD.findall(t.lower()) for t in texts]
        size = np.array([len(w) for w in found], np.int64)
        number: dict[str, int] = {}
        at = np.fromiter((number.setdefault(w, len(number)) for words in found for w in words), np.int64, int(size.sum()))
        h = np.fromiter((zlib.crc32(w.encode()) for w in number), np.int64, len(number))
        direction = _directions(self.dimensions)[h % DIRECTIONS] * np.where(h >> 31 & 1, 1, -1).astype(np.float32)[:, None]
        out = np.zeros((len(texts), self.dimensions), np.float32)
        some, first = np.flatnonzero(size), np.cumsum(size) - size
        for i in some:
            w, n = np.unique(at[first[i] : first[i] + size[i]], return_counts=True)
            out[i] = n.astype(np.float32) @ direction[w] / size[i]
        return normalize(out)


class OnnxEmbedder:
    """A sentence model from an ONNX file and its tokenizer file: its inputs by their usual names, or in their usual order; first output pooled and normalised."""

    def __init__(self, model_path: str, tokenizer_path: str) -> None:
        self.model_path, self.tokenizer_path, self._loaded = model_path, tokenizer_path, None

    def __getstate__(self) -> dict:
        return {"model_path": self.model_path, "tokenizer_path": self.tokenizer_path, "_loaded": None}

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(self.tokenizer_path)
            tok.enable_padding()
            self._loaded = onnxruntime.InferenceSession(self.model_path, providers=["CPUExecutionProvider"]), tok
        session, tok = self._loaded
        enc = tok.encode_batch(texts, add_special_tokens=False)
        ids, mask = (np.array([getattr(e, a) for e in enc], np.int64).reshape(len(enc), -1) for a in ("ids", "attention_mask"))
        known = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        names = [i.name for i in session.get_inputs()]
        feed = {n: known[n] for n in names} if set(names) <= set(known) else dict(zip(names, known.values(), strict=False))
        out = session.run(None, feed)[0]
        return normalize(mean_pool(out, mask) if out.ndim == 3 else out)


def embed(texts: DataFrame, embedder: Embedder | None = None, text_col: str = "text", to: str = "embedding") -> DataFrame:
    """``texts`` with a vector column. A null text has a null vector; one without words has zeros."""
    return texts.withColumn(to, embed_column(F.col(text_col), embedder))


def embed_column(text: Column, embedder: Embedder | None = None) -> Column:
    model = embedder or HashingEmbedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = pd.Series([None] * len(s), dtype=object)
            some = np.flatnonzero(s.notna())
            if len(some):
                for i, v in zip(some, model(s.iloc[some].tolist()), strict=True):
                    out.iloc[i] = v
            yield out

    return run(text)


def sentences(docs: DataFrame, text_col: str = "text", shortest: int = 40, longest: int = 200) -> DataFrame:
    """``docs`` with one row per ``sentence`` of ``shortest`` to ``longest`` characters; sentences end at . ! or ? before white space."""
    parts = docs.withColumn("sentence", F.explode(F.split(text_col, r"[.!?]\s+")))
    return parts.where(F.length("sentence").between(shortest, longest))
