"""From raw documents to packed training bins: each stage is written as Parquet and read again as the next one's input.

Every stage takes documents with nulls in any column, empty and very long texts, repeated rows, further columns of any name and
empty tables, and does with them what the docstring of its operator says: rows without a doc_id are scored by the classifier
and searched for benchmark items as others are, stay through both dedups, and are packed with a null for an id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexmark.llm import decontam, graph, line_dedup, packing, quality, simhash
from vexmark.llm.textcore import load, unused

#: A document that loses FEW lines or more to line dedup, and with them more than this share of its characters, goes: what is left of
#: it are the lines in which a copy was edited. One that loses fewer lines, such as a notice around a short text, keeps the rest.
MOST_LOST, FEW = 0.5, 4


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted on the labelled documents of its input."""
    return quality.drop_rejected(docs, load(spark, sf_dir, "labels"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, and documents that had nothing or little else (see MOST_LOST); ``n_chars`` follows the text.

    Documents that lose no line stay as they are, null and empty texts among them.
    """
    lost, before = unused(docs, "lines_lost", "length_before")
    sized = docs.withColumn(before, F.length("text"))
    out = line_dedup.drop_recurring_lines(sized, count_col=lost, exact=True).where(f"{lost} = 0 OR (text <> '' AND ({lost} < {FEW} OR length(text) >= {1 - MOST_LOST} * {before}))").drop(lost, before)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as training sequences of fixed capacity."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("line dedup", drop_recurring_lines),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: No stage but the last line filters could be written in SQL; the tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What lies between two stages goes to the session's shared checkpoint folder, a stage's input until its output is written."""
    docs = load(spark, sf_dir, "documents")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{graph.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder.toString()}/{k}")
            docs = spark.read.parquet(f"{folder.toString()}/{k}")
            if k:
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, str(k - 1)), True)
    return docs
