"""Bulk ingest: a raw embedding file and a text file, row by row, into a collection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embed import Embedder, HashingEmbedder
from .operators.evaluate import Timing, timed
from .plans.collection import Collection
from .sources.lines import lookup, read_lines
from .sources.rawvec import read_f32, trailing_bytes
from .types import EMBEDDING_DIMENSION, CollectionConfig, Metric


def zip_rows(vectors: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, embedding, text): row n with line n, as far as the shorter side goes."""
    return vectors.join(lines, "id").select("id", "embedding", "text")


@dataclass(frozen=True)
class Report:
    collection: Collection
    timing: Timing
    message: str = ""


def ingest(spark: SparkSession, embeddings: str, texts: str, out: str, dimensions: int = EMBEDDING_DIMENSION, name: str = "owt", metric: Metric = Metric.L2) -> Report:
    """A saved collection with line numbers as ids and each line as ``{"text": ...}``.

    Vectors beyond the last line are left out; if there are fewer vectors than lines, the message says so and the rest is
    kept.
    """
    rows = zip_rows(read_f32(spark, embeddings, dimensions), (lines := read_lines(spark, texts)))
    collection = Collection(spark, CollectionConfig(name, dimensions, metric), path=out)
    timing = timed(lambda: collection.insert_batch(rows.select("id", "embedding"), "id").where("status = 'kOk'"))
    collection.set_metadata_batch(rows.select("id", F.to_json(F.struct("text")).alias("metadata")))
    collection.save()
    short = lines.count() - timing.rows
    cut = trailing_bytes(spark, embeddings, dimensions)
    message = f"{short} lines without a vector" if short > 0 else ""
    return Report(collection, timing, f"{message}; {cut} bytes after the last vector".strip("; ") if cut else message)


def search_text(spark: SparkSession, collection: Collection, text: str, lines: DataFrame | None, k: int = 10, embedder: Embedder | None = None) -> DataFrame:
    """(rank, id, score, text) of the lines nearest to a text."""
    vector = (embedder or HashingEmbedder(collection.dimension))([text])[0]
    return lookup(collection.search([float(v) for v in vector], k), lines).orderBy("rank")
