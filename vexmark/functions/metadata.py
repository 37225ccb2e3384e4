"""Per-vector metadata: flat JSON objects of integers, doubles, strings and booleans."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Code, EngineError

Value = int | float | str | bool
KINDS = {"BIGINT": "int64", "DOUBLE": "double", "STRING": "string", "BOOLEAN": "bool"}


def dumps(metadata: dict[str, Value]) -> str:
    """JSON text of one map, keys in order; kInvalidArgument for values of other kinds."""
    for k, v in metadata.items():
        if not isinstance(k, str) or not isinstance(v, (bool, int, float, str)):
            raise EngineError(Code.INVALID_ARGUMENT, f"metadata {k!r} has unsupported type {type(v).__name__}")
    return json.dumps(metadata, sort_keys=True, ensure_ascii=False)


def loads(text: str) -> dict[str, Value]:
    """The map of a JSON text; kInvalidArgument for anything but a flat object of supported values."""
    try:
        doc: Any = json.loads(text)
    except ValueError as e:
        raise EngineError(Code.INVALID_ARGUMENT, f"metadata is not JSON: {e}") from None
    if not isinstance(doc, dict):
        raise EngineError(Code.INVALID_ARGUMENT, "metadata is not a JSON object")
    dumps(doc)
    return doc


def status(metadata: Column) -> Column:
    """kOk for a flat object of supported values, else kInvalidArgument; null counts as no metadata and is fine."""
    parsed = F.try_parse_json(metadata)
    shape = F.schema_of_variant(parsed)
    nested = shape.rlike(r"(: |, )(ARRAY|OBJECT|VOID|VARIANT)|ARRAY<|OBJECT<.*OBJECT<|: VOID")
    good = parsed.isNotNull() & shape.startswith("OBJECT<") & ~nested
    return F.when(metadata.isNull() | good, "kOk").otherwise("kInvalidArgument")


def get(metadata: Column, key: str, kind: str) -> Column:
    """One value as ``kind`` (long, double, string or boolean); null if it is absent or doesn't cast."""
    return F.try_variant_get(F.try_parse_json(metadata), f"$.{key}", kind)


def entries(rows: DataFrame, id_col: str = "id", metadata_col: str = "metadata") -> DataFrame:
    """(id, key, kind, value): one row per value, ``kind`` as int64, double, string or bool."""
    v = rows.select(F.col(id_col).alias("id"), F.try_parse_json(metadata_col).alias("v")).where("v IS NOT NULL")
    each = v.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
    shape = F.schema_of_variant("value")
    kind = F.when(shape.startswith("DECIMAL"), "double")
    for name, k in KINDS.items():
        kind = kind.when(shape == name, k)
    return each.select("id", "key", kind.alias("kind"), F.expr("cast(value AS string)").alias("value"))


def export_rows(rows: DataFrame, id_col: str = "id", metadata_col: str = "metadata") -> DataFrame:
    """(id, entry): each row's part of an exported file, ``"<id>": {...}``."""
    return rows.select(F.col(id_col).alias("id"), F.concat(F.lit('"'), F.col(id_col).cast("string"), F.lit('": '), F.coalesce(metadata_col, F.lit("{}"))).alias("entry"))


def import_rows(documents: DataFrame, text_col: str = "value") -> DataFrame:
    """(id, metadata) of id-keyed JSON objects, one whole object a row. Texts that are no such objects fail the query."""
    keys = F.from_json(F.col(text_col), "map<string,string>", {"mode": "FAILFAST"})
    return documents.select(F.explode(keys).alias("key", "metadata")).select(F.col("key").cast("long").alias("id"), "metadata")
