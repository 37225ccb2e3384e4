"""A database: a folder of collections by name."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..errors import Code, EngineError
from ..files import Files
from ..types import CollectionConfig, IndexOptions
from .collection import Collection


class Database:
    """Collections of a data folder; without one they last as long as the session.

    Collections that can't be opened are not silently skipped: ``load_errors`` lists them, and the rest can be used.
    """

    def __init__(self, spark: SparkSession, data_dir: str | None = None, default_index_options: IndexOptions | None = None) -> None:
        self.spark, self.files = spark, Files(spark)
        self.data_dir = data_dir.rstrip("/") if data_dir else None
        self.default_index_options = default_index_options or IndexOptions()
        self._open: dict[str, Collection] = {}
        self._errors: list[tuple[str, str, str]] = []
        if self.data_dir:
            self.files.make(self.data_dir)
            for name in self.files.names(self.data_dir):
                if self.files.exists(f"{self.data_dir}/{name}/meta.json"):
                    try:
                        self._open[name] = Collection.load(spark, f"{self.data_dir}/{name}")
                    except EngineError as e:
                        self._errors.append((name, e.code.value, e.message))

    def create_collection(self, name: str, config: CollectionConfig, options: IndexOptions | None = None) -> Collection:
        """A new, empty collection; an empty ``config.name`` becomes ``name``. kAlreadyExists if there is one of that name."""
        if not name or "/" in name or name[0] in "._":
            raise EngineError(Code.INVALID_ARGUMENT, f"bad collection name {name!r}")
        if name in self._open or any(name == n for n, *_ in self._errors):
            raise EngineError(Code.ALREADY_EXISTS, name)
        config = config if config.name else replace(config, name=name)
        self._open[name] = Collection(self.spark, config, options or self.default_index_options, f"{self.data_dir}/{name}" if self.data_dir else None)
        return self._open[name]

    def get_collection(self, name: str) -> Collection:
        if name not in self._open:
            raise EngineError(Code.NOT_FOUND, name)
        return self._open[name]

    def drop_collection(self, name: str) -> None:
        """Forget a collection and delete its files."""
        path = self.get_collection(name).path
        del self._open[name]
        self.files.delete(path)

    def has_collection(self, name: str) -> bool:
        return name in self._open

    def list_collections(self) -> list[str]:
        return sorted(self._open)

    def collections(self) -> DataFrame:
        """(name, dimensions, metric) of all collections."""
        rows = [(n, c.dimension, c.metric.value) for n, c in sorted(self._open.items())]
        return self.spark.createDataFrame(rows, "name string, dimensions int, metric string")

    def load_errors(self) -> DataFrame:
        """(name, code, message) of the folders that could not be opened."""
        return self.spark.createDataFrame(self._errors, "name string, code string, message string")

    def close(self) -> None:
        """Save all collections; the first failure ends it."""
        for c in self._open.values():
            c.close()

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
