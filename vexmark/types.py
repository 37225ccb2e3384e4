"""Collection settings and their JSON form."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from enum import Enum
from typing import Any

from .errors import Code, EngineError

#: dimension of the sentence embedder's vectors
EMBEDDING_DIMENSION = 384
#: vectors wider than this are refused by the log readers
MAX_DIMENSION = 65_536


class Metric(str, Enum):
    COSINE = "Cosine"
    L2 = "L2"
    INNER_PRODUCT = "InnerProduct"

    @property
    def ascending(self) -> bool:
        """Whether the smallest score is best."""
        return self is Metric.L2


class DataType(str, Enum):
    FLOAT32 = "Float32"
    INT32 = "Int32"


class IndexType(str, Enum):
    HNSW = "HNSW"


def parse_enum(kind: type[Enum], name: Any) -> Any:
    """The member called ``name``; kInvalidArgument for any other name."""
    try:
        return kind(name)
    except ValueError:
        raise EngineError(Code.INVALID_ARGUMENT, f"unknown {kind.__name__}: {name!r}") from None


@dataclass(frozen=True)
class IndexOptions:
    """Graph-index settings, kept for exchange; ``ef_search`` sets how many candidates approximate search looks at."""

    max_elements: int = 1_000_000
    m: int = 64
    ef_construction: int = 200
    ef_search: int = 200

    def reserve(self, _elements: int) -> None:
        """Capacity is unlimited here, so there is nothing to reserve."""


@dataclass(frozen=True)
class CollectionConfig:
    name: str
    dimensions: int
    metric: Metric = Metric.COSINE
    dtype: DataType = DataType.FLOAT32
    index: IndexType = IndexType.HNSW

    def __post_init__(self) -> None:
        if not 0 < self.dimensions <= MAX_DIMENSION:
            raise EngineError(Code.INVALID_ARGUMENT, f"dimensions must lie in 1..{MAX_DIMENSION}")
        if self.dtype is not DataType.FLOAT32:
            raise EngineError(Code.UNIMPLEMENTED, "vectors are Float32")


@dataclass(frozen=True)
class Recovery:
    last_lsn: int = 0
    last_txid: int = 0
    clean_shutdown: bool = False


@dataclass(frozen=True)
class CollectionMeta:
    """Everything that meta.json holds."""

    config: CollectionConfig
    options: IndexOptions = field(default_factory=IndexOptions)
    recovery: Recovery = field(default_factory=Recovery)
    snapshot: int = 0
    index: int = 0

    def to_json(self) -> dict[str, Any]:
        c, o, r = self.config, self.options, self.recovery
        out: dict[str, Any] = dict(name=c.name, dimensions=c.dimensions, metric=c.metric.value, dtype=c.dtype.value, idxType=c.index.value)
        out["hnsw"] = dict(maxElements=o.max_elements, M=o.m, efConstruction=o.ef_construction, efSearch=o.ef_search)
        out["recovery"] = dict(lastPersistedLsn=r.last_lsn, lastPersistedTxid=r.last_txid, cleanShutdown=r.clean_shutdown)
        out["snapshotVersion"] = self.snapshot
        out["indexVersion"] = self.index
        return out

    @classmethod
    def from_json(cls, doc: Any) -> CollectionMeta:
        """Index and recovery settings may be missing; the rest must be there."""
        if not isinstance(doc, dict):
            raise EngineError(Code.CORRUPTION, "settings are not a JSON object")
        missing = [k for k in ("name", "dimensions", "metric", "dtype", "idxType") if k not in doc]
        if missing:
            raise EngineError(Code.CORRUPTION, f"settings lack {', '.join(missing)}")
        config = CollectionConfig(doc["name"], int(doc["dimensions"]), parse_enum(Metric, doc["metric"]), parse_enum(DataType, doc["dtype"]), parse_enum(IndexType, doc["idxType"]))
        o, r, base = doc.get("hnsw", {}), doc.get("recovery", {}), asdict(IndexOptions())
        options = IndexOptions(o.get("maxElements", base["max_elements"]), o.get("M", base["m"]), o.get("efConstruction", base["ef_construction"]), o.get("efSearch", base["ef_search"]))
        return cls(config, options, Recovery(r.get("lastPersistedLsn", 0), r.get("lastPersistedTxid", 0), r.get("cleanShutdown", False)), doc.get("snapshotVersion", 0), doc.get("indexVersion", 0))
