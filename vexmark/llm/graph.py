"""Connected components of an edge table, with each round's edges in the session's shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..files import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()``, with the folder seen to."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node of each node's component, for every node that has an edge in ``edges(a, b)``.

    Alternating large-star and small-star steps, each the least neighbour of each node, aggregated before the shuffle and joined
    to the edges, so that a node with a third of all edges is split by AQE and not one task's. A round's edges are
    checkpointed, so an executor lost later costs no recomputation of earlier rounds. The number of rounds grows with the logarithm of the
    diameter. Raises if the components have not settled after ``max_rounds``.
    """
    e = checkpointed(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    last = None
    for _ in range(max_rounds):
        both = e.union(e.selectExpr("v AS u", "u AS v"))
        m = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = e.selectExpr("v AS u", "u AS w").join(m, "u").where("w <> m").selectExpr("w AS u", "m AS v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = m.selectExpr("u", "m AS v").union(large.join(m, "u").where("v <> m").selectExpr("v AS u", "m AS v")).where("u <> v").distinct()
        e = checkpointed(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return e.selectExpr("u AS node", "v AS root").union(e.selectExpr("v AS node", "v AS root").distinct())
        last = state
    raise RuntimeError("components have not settled")
