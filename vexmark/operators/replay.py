"""The state that a snapshot and a change log make together.

A snapshot is ``(id, embedding, deleted)`` with unique ids, a log ``(lsn, txid, op, id, embedding)``. Only the log is aggregated;
the snapshot loses the ids that the log has something to say about by an anti join and otherwise keeps its place, so replay
moves what changed and not what is stored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dimension_status

REPLAYED = ("INSERT", "DELETE")


def pending(log: DataFrame, after_lsn: int) -> DataFrame:
    """Records after ``after_lsn`` that change the state; the other operations only advance the counters."""
    return log.where((F.col("lsn") > after_lsn) & F.col("op").isin(*REPLAYED))


def last_writer(log: DataFrame) -> DataFrame:
    """(id, lsn, op, embedding, inserted): each id's last record, and whether it was ever inserted."""
    return log.groupBy("id").agg(F.max("lsn").alias("lsn"), F.max_by(F.struct("op", "embedding"), "lsn").alias("last"), F.max((F.col("op") == "INSERT").cast("int")).alias("inserted")).select("id", "lsn", "last.op", "last.embedding", (F.col("inserted") == 1).alias("inserted"))


def merged(snapshot: DataFrame | None, log: DataFrame | None, after_lsn: int = 0) -> DataFrame:
    """(id, embedding, deleted): the last writer of each id wins; a deleted id stays as a tombstone without a vector.

    A delete of an id that never was there leaves nothing.
    """
    if log is None:
        return snapshot
    last = last_writer(pending(log, after_lsn))
    gone = F.col("op") == "DELETE"
    now = last.select("id", F.when(~gone, F.col("embedding")).alias("embedding"), gone.alias("deleted"), "inserted")
    if snapshot is None:
        return now.where("inserted OR NOT deleted").drop("inserted")
    kept = snapshot.select("id", "embedding", "deleted").join(last.select("id"), "id", "left_anti")
    known = now.join(snapshot.select("id", F.lit(True).alias("stored")), "id", "left").where("inserted OR NOT deleted OR stored")
    return kept.unionByName(known.select("id", "embedding", "deleted"))


def live(state: DataFrame) -> DataFrame:
    """(id, embedding) of what a search may find."""
    return state.where(~F.col("deleted")).select("id", "embedding")


def size_of(state: DataFrame) -> int:
    """How many ids there are, tombstones included."""
    return state.count()


def counters(log: DataFrame, last_lsn: int = 0, last_txid: int = 0) -> DataFrame:
    """(next_lsn, next_txid, replayed, recovered) after a log is read from ``last_lsn`` on."""
    later = log.where(F.col("lsn") > last_lsn)
    return later.agg(
        F.coalesce(F.greatest(F.max("lsn"), F.lit(last_lsn)) + 1, F.lit(last_lsn + 1)).cast("long").alias("next_lsn"),
        F.coalesce(F.greatest(F.max("txid"), F.lit(last_txid)) + 1, F.lit(last_txid + 1)).cast("long").alias("next_txid"),
        F.count_if(F.col("op").isin(*REPLAYED)).alias("replayed"),
        (F.count_if(F.col("op").isin(*REPLAYED)) > 0).alias("recovered"),
    )


def batch_status(batch: DataFrame, dimensions: int, vector_col: str = "embedding") -> DataFrame:
    """``batch`` with ``status`` and ``message``: a vector of another size fails its row and no other."""
    status = dimension_status(F.col(vector_col), dimensions)
    have = F.coalesce(F.size(vector_col), F.lit(0)).cast("string")
    message = F.when(status == "kOk", "").otherwise(F.concat(F.lit(f"expected {dimensions} dimensions, got "), have))
    return batch.withColumns({"status": status, "message": message})


def batch_counts(status: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("status") == "kOk")
    return status.agg(ok.alias("success_count"), (F.count("*") - ok).alias("failure_count"))


def latest_metadata(changes: DataFrame, seq: str | Column = "seq") -> DataFrame:
    """(id, metadata): the last map set for each id; ids whose last change is null have none."""
    return changes.groupBy("id").agg(F.max_by(F.struct("metadata"), seq).alias("m")).select("id", "m.metadata").where("metadata IS NOT NULL")


def _range_of(pos: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at most ``pos``: among every so many of them first, then among those between."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1

    def at_most(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= pos))

    def literal(values: list[int]) -> Column:
        return F.array(*(F.lit(v).cast("long") for v in values))

    head = at_most(literal(cuts[::step]))
    parts = F.array(*(literal(cuts[i : i + step]) for i in range(0, len(cuts), step)))
    return F.when(head == 0, 0).otherwise((head - 1) * step + at_most(F.get(parts, head - 1)))


def numbered(rows: DataFrame, first: int) -> DataFrame:
    """``rows`` with ``lsn`` counting from ``first`` in the order of ``pos``, without gaps.

    Ranks within ranges of ``pos``, cut at its quantiles so that they hold about as many rows each wherever those lie, are
    shifted by the sizes of the ranges before; one number per range goes to the driver, and no partition ever holds all
    rows. ``rows`` must give the same result each time it is computed, and ``pos`` is not null and has no ties.
    """
    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({int(c) for c in rows.approxQuantile("pos", [i / width for i in range(1, width)], 1 / (4 * width))}) if width > 1 else []
    ranged = rows.withColumn("__b", _range_of(F.col("pos"), cuts))
    sizes = {r["__b"]: r["n"] for r in ranged.groupBy("__b").agg(F.count("*").alias("n")).collect()}
    start, at = [], first
    for b in range(len(cuts) + 1):
        start.append(at)
        at += sizes.get(b, 0)
    base = F.element_at(F.array(*(F.lit(s).cast("long") for s in start)), F.col("__b") + 1)
    return ranged.withColumn("lsn", base + F.row_number().over(Window.partitionBy("__b").orderBy("pos")) - 1).drop("__b")
