"""How good and how fast a search is."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_lists(hits: DataFrame) -> DataFrame:
    """(qid, ids): each query's ids in the order of rank."""
    return hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("ids"))


def recalls(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall) at k for every query of ``truth``, both as (qid, ids): the share of its first k, or of all if they are fewer."""
    f = found.select("qid", F.slice("ids", 1, k).alias("got"))
    t = truth.select("qid", F.slice("ids", 1, k).alias("want")).where(F.size("want") > 0)
    none = F.expr("cast(array() AS array<bigint>)")
    return t.join(f, "qid", "left").select("qid", (F.size(F.array_intersect("want", F.coalesce("got", none))) / F.size("want")).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    return recalls(found, truth, k).agg(F.avg("recall").alias("recall"), F.count("*").alias("queries"))


def common_hits(found: DataFrame, truth: DataFrame) -> DataFrame:
    """The rows (qid, id) of ``found`` that are in ``truth``."""
    return found.join(truth.select("qid", "id"), ["qid", "id"], "left_semi")


@dataclass(frozen=True)
class Timing:
    rows: int
    seconds: float

    @property
    def per_second(self) -> int:
        """Whole rows a second; 0 if no time passed."""
        return int(self.rows / self.seconds) if self.seconds > 0 else 0


def timed(run: Callable[[], DataFrame]) -> Timing:
    """Rows and seconds of a query, run to its end."""
    began = time.perf_counter()
    rows = run().count()
    return Timing(rows, time.perf_counter() - began)
