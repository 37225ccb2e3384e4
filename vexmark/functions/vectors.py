"""Arithmetic on ``array<float>`` columns, in double precision and inside Catalyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Metric

#: norms up to this leave a vector as it is
TINY_NORM = 1e-12


def literal(values: Sequence[float]) -> Column:
    """A vector as a constant ``array<double>``."""
    return F.array(*(F.lit(float(v)) for v in values)) if len(values) else F.expr("cast(array() AS array<double>)")


def dot(a: Column, b: Column) -> Column:
    """Sum of products, added from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, v: s + v)


def score(metric: Metric, a: Column, b: Column) -> Column:
    """Cosine and inner product: a.b - 1, nothing is normalised; L2: the squared distance, where small is good."""
    return squared_distance(a, b) if metric is Metric.L2 else dot(a, b) - 1


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """``v`` of length 1; a vector of almost no length comes back unchanged."""
    n = norm(v)
    return F.when(n > TINY_NORM, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


def payload_bytes(v: Column) -> Column:
    """Bytes that a vector takes in a binary log; a null vector takes none."""
    return F.coalesce(F.size(v), F.lit(0)) * 4


def vector_text(v: Column) -> Column:
    """A vector as JSON text."""
    return F.to_json(v)


def dimension_status(v: Column, dimensions: int) -> Column:
    """kOk, or kDimensionMismatch for a vector of any other size, a null one among them."""
    return F.when(F.size(v) == dimensions, "kOk").otherwise("kDimensionMismatch")
