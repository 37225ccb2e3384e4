"""A named collection: versioned Parquet snapshots, a Parquet change log by LSN, and meta.json.

    <dir>/meta.json            settings, counters and the snapshot's version; replaced by a rename, last of all
    <dir>/snapshot/v=<n>/      (id, embedding, deleted, metadata)
    <dir>/log/<lsn>/           one commit's records (lsn, txid, op, id, dimension, embedding), first LSN as its name
    <dir>/index/v=<n>/         an inverted file of the vectors up to some LSN; see ``operators.ann``

A save keeps the snapshot before it and the commits that it holds until the next one, for readers that still use them.
A commit is a Parquet write; it counts once its ``_SUCCESS`` is there. Without a path everything lives in the session's
scratch folder and is gone with it. Handles are for one writer at a time; readers may open the same folder.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Code, EngineError, Status
from ..files import Files, kept, scratch
from ..functions import metadata as M
from ..operators import ann
from ..operators import replay as R
from ..operators import search as S
from ..types import CollectionConfig, CollectionMeta, IndexOptions, Recovery

SNAPSHOT = "id long, embedding array<float>, deleted boolean, metadata string"
LOG = "lsn long, txid long, op string, id long, dimension int, embedding array<float>"
_SEQ = "seq long, id long, metadata string"
SINGLES, FRAMES, STALE = 10_000, 8, 0.2


class Collection:
    def __init__(self, spark: SparkSession, config: CollectionConfig, options: IndexOptions | None = None, path: str | None = None) -> None:
        """A new collection; with a path, its settings are written at once, so that it is found again without a save."""
        self.spark, self.files = spark, Files(spark)
        self.persistent = path is not None
        self.path = path.rstrip("/") if path is not None else scratch(spark)
        self.meta = CollectionMeta(config, options or IndexOptions())
        self.next_lsn = self.next_txid = 1
        self.recovered_from_log = False
        self._seq, self._changes, self._single = 0, [], {}
        self._index: ann.Index | None = None
        if self.persistent:
            if self.files.exists(f"{self.path}/meta.json"):
                raise EngineError(Code.ALREADY_EXISTS, self.path)
            self._publish(self.meta)

    # -- opening -----------------------------------------------------------------------------------------------------

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Collection:
        """The saved state and what the log has after it. kNotFound without meta.json; a damaged log raises."""
        files = Files(spark)
        path = path.rstrip("/")
        if not files.exists(f"{path}/meta.json"):
            raise EngineError(Code.NOT_FOUND, f"no collection at {path}")
        self = cls.__new__(cls)
        self.spark, self.files, self.path, self.persistent = spark, files, path, True
        self._seq, self._changes, self._single, self._index = 0, [], {}, None
        self.meta = cls.read_meta(spark, path)
        if self.meta.snapshot and not files.exists(f"{path}/snapshot/v={self.meta.snapshot}/_SUCCESS"):
            raise EngineError(Code.NOT_FOUND, f"{path} lacks snapshot {self.meta.snapshot}")
        r = self.meta.recovery
        self.next_lsn, self.next_txid, self.recovered_from_log = r.last_lsn + 1, r.last_txid + 1, False
        if self.meta.index:
            self._index = ann.load(spark, f"{path}/index/v={self.meta.index}")
        log = self.log()
        if log is not None:
            got = R.counters(log, r.last_lsn, r.last_txid).first()
            self.next_lsn, self.next_txid, self.recovered_from_log = got["next_lsn"], got["next_txid"], got["recovered"]
            bad = log.where(F.col("lsn") > r.last_lsn).where((F.col("op") == "INSERT") & (F.coalesce(F.size("embedding"), F.lit(-1)) != self.dimension))
            if bad.limit(1).count():
                raise EngineError(Code.INTERNAL, f"{path}: the log inserts vectors of another dimension")
        return self

    @staticmethod
    def read_meta(spark: SparkSession, path: str) -> CollectionMeta:
        try:
            return CollectionMeta.from_json(json.loads(Files(spark).read(f"{path}/meta.json")))
        except ValueError as e:
            raise EngineError(Code.CORRUPTION, f"{path}/meta.json: {e}") from None

    def _publish(self, meta: CollectionMeta) -> None:
        self.files.write(f"{self.path}/meta.json", json.dumps(meta.to_json(), indent=2).encode())
        self.meta = meta

    # -- what it is --------------------------------------------------------------------------------------------------

    @property
    def name(self) -> str:
        return self.meta.config.name

    @property
    def dimension(self) -> int:
        return self.meta.config.dimensions

    @property
    def metric(self):
        return self.meta.config.metric

    def size(self) -> int:
        """Ids, tombstones included."""
        state = self.state()
        return 0 if state is None else R.size_of(state)

    def __len__(self) -> int:
        return self.size()

    # -- the state ---------------------------------------------------------------------------------------------------

    def snapshot(self) -> DataFrame | None:
        v = self.meta.snapshot
        return self.spark.read.schema(SNAPSHOT).parquet(f"{self.path}/snapshot/v={v}") if v else None

    def commits(self) -> list[str]:
        """Folders of the log's whole commits that the snapshot doesn't hold, in order."""
        names = [n for n in self.files.whole(f"{self.path}/log") if n.isdigit()]
        return [f"{self.path}/log/{n}" for n in names if int(n) > self.meta.recovery.last_lsn]

    def log(self) -> DataFrame | None:
        found = self.commits()
        return self.spark.read.schema(LOG).parquet(*found) if found else None

    def state(self) -> DataFrame | None:
        """(id, embedding, deleted); None if nothing was ever written. Snapshot rows with metadata alone are no vectors."""
        saved = self.snapshot()
        return R.merged(saved if saved is None else saved.where("deleted IS NOT NULL").select("id", "embedding", "deleted"), self.log(), self.meta.recovery.last_lsn)

    def live_view(self) -> DataFrame:
        """(id, embedding) of all vectors that a search may find."""
        state = self.state()
        return self.spark.createDataFrame([], "id long, embedding array<float>") if state is None else R.live(state)

    def metadata(self) -> DataFrame:
        """(id, metadata) as JSON text."""
        saved, changes = self.snapshot(), self._all_changes()
        if saved is not None:
            first = saved.where("metadata IS NOT NULL").select("id", "metadata")
            if changes is None:
                return first
            return first.join(changes.select("id").distinct(), "id", "left_anti").unionByName(R.latest_metadata(changes))
        return self.spark.createDataFrame([], "id long, metadata string") if changes is None else R.latest_metadata(changes)

    # -- changes -----------------------------------------------------------------------------------------------------

    def insert(self, id: int, vector: Sequence[float]) -> Status:
        """Insert or replace one vector."""
        if len(vector) != self.dimension:
            return Status(Code.DIMENSION_MISMATCH, f"expected {self.dimension} dimensions, got {len(vector)}")
        one = self.spark.createDataFrame([(0, int(id), [float(x) for x in vector])], "pos long, id long, embedding array<float>")
        self._append(one.select(F.lit(self.next_lsn).cast("long").alias("lsn"), "id", F.lit("INSERT").alias("op"), "embedding"), 1)
        return Status()

    def insert_batch(self, batch: DataFrame, pos_col: str | None = None) -> DataFrame:
        """(pos, id, status, message) of each row of ``batch(id, embedding)``; valid rows go into the log as one commit.

        Rows count in the order of ``pos_col``, an integer, or as they come; of equal ids the last one wins.
        """
        pos = F.col(pos_col).cast("long") if pos_col else F.monotonically_increasing_id()
        rows = kept(R.batch_status(batch.select(pos.alias("pos"), F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")), self.dimension))
        valid = rows.where("status = 'kOk'")
        n = valid.count()
        if n:
            self._append(R.numbered(valid, self.next_lsn).select("lsn", "id", F.lit("INSERT").alias("op"), "embedding"), n)
        return rows.select("pos", "id", "status", "message")

    def remove(self, id: int) -> Status:
        """Put a tombstone on ``id`` and forget its metadata; kNotFound if it never was there, though the LSN is used up."""
        state = self.state()
        known = state is not None and state.where(F.col("id") == int(id)).limit(1).count() > 0
        one = self.spark.createDataFrame([(self.next_lsn, int(id), "DELETE", None)], "lsn long, id long, op string, embedding array<float>")
        self._append(one, 1)
        if not known:
            return Status(Code.NOT_FOUND, f"no vector {id}")
        self._change_one(int(id), None)
        return Status()

    def remove_batch(self, ids: DataFrame, id_col: str = "id") -> None:
        """Tombstones for all of ``ids`` in one commit."""
        rows = kept(ids.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct())
        n = rows.count()
        if n:
            self._append(R.numbered(rows.withColumn("pos", F.col("id")), self.next_lsn).select("lsn", "id", F.lit("DELETE").alias("op"), F.lit(None).cast("array<float>").alias("embedding")), n)
            self._change(rows.select(F.lit(0).cast("long").alias("seq"), "id", F.lit(None).cast("string").alias("metadata")))

    def apply_batch(self, changes: DataFrame, pos_col: str) -> int:
        """Insertions and removals, ``changes(id, op, embedding)`` in the order of ``pos_col``, as one commit; how many there were.

        Vectors of another size fail the call as a whole. ``changes`` must give the same rows each time it is computed.
        """
        rows = changes.select(F.col(pos_col).cast("long").alias("pos"), F.col("id").cast("long").alias("id"), "op", F.col("embedding").cast("array<float>").alias("embedding"))
        ok = (F.col("op") == "DELETE") | ((F.col("op") == "INSERT") & (F.size("embedding") == self.dimension))
        n, good = rows.agg(F.count("*"), F.count_if(ok & F.col("id").isNotNull())).first()
        if good != n:
            raise EngineError(Code.DIMENSION_MISMATCH, f"{n - good} of {n} changes are no removals and no vectors of {self.dimension} dimensions")
        if n:
            self._append(R.numbered(rows, self.next_lsn).select("lsn", "id", "op", F.when(F.col("op") == "INSERT", F.col("embedding")).alias("embedding")), n)
            gone = R.last_writer(rows.withColumnRenamed("pos", "lsn")).where("op = 'DELETE'")
            self._change(gone.select(F.lit(0).cast("long").alias("seq"), "id", F.lit(None).cast("string").alias("metadata")))
        return n

    def _append(self, rows: DataFrame, n: int) -> None:
        """One commit of ``n`` records; the counters move only if it is written."""
        shift = self.next_txid - self.next_lsn
        out = rows.select("lsn", (F.col("lsn") + shift).alias("txid"), "op", "id", F.coalesce(F.size("embedding"), F.lit(0)).alias("dimension"), "embedding")
        out.write.mode("overwrite").parquet(f"{self.path}/log/{self.next_lsn:020d}")
        self.next_lsn += n
        self.next_txid += n

    def set_metadata(self, id: int, metadata: dict[str, M.Value]) -> None:
        """Replace the whole map of ``id``, which needn't exist. It is not in the log: until a save, it lives in this handle."""
        self._change_one(int(id), M.dumps(metadata))

    def set_metadata_batch(self, rows: DataFrame) -> None:
        """Maps of many ids, ``(id, metadata)`` with JSON text; any that isn't a flat object makes the call fail as a whole."""
        rows = kept(rows.select(F.lit(0).cast("long").alias("seq"), F.col("id").cast("long").alias("id"), F.col("metadata").cast("string").alias("metadata")))
        if rows.where(M.status(F.col("metadata")) != "kOk").limit(1).count():
            raise EngineError(Code.INVALID_ARGUMENT, "metadata must be flat JSON objects")
        self._change(rows)

    def _change_one(self, id: int, metadata: str | None) -> None:
        self._seq += 1
        self._single[id] = (self._seq, id, metadata)
        if len(self._single) == SINGLES:
            self._fold()

    def _change(self, rows: DataFrame) -> None:
        self._seq += 1
        self._changes.append(rows.withColumn("seq", F.lit(self._seq).cast("long")))
        if len(self._changes) == FRAMES:
            self._fold()

    def _all_changes(self) -> DataFrame | None:
        """(seq, id, metadata) of everything since the last save."""
        frames = [*self._changes, *([self.spark.createDataFrame(list(self._single.values()), _SEQ)] if self._single else [])]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def _fold(self) -> None:
        """The changes so far as one written table, so that plans stay small however many calls there are."""
        last = self._all_changes().groupBy("id").agg(F.max("seq").alias("seq"), F.max_by(F.struct("metadata"), "seq").alias("m"))
        self._changes, self._single = [kept(last.select("seq", "id", "m.metadata"))], {}

    # -- searches ----------------------------------------------------------------------------------------------------

    def search(self, query: Sequence[float], k: int, ef: int | None = None) -> DataFrame:
        """(rank, id, score); as ``search_batch`` for one query."""
        if ef is None or self._index is None:
            return S.knn(self.live_view(), query, k, self.metric, self.dimension)
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "qid long, qv array<float>")
        return self.search_batch(one, k, ef).drop("qid")

    def query(self, query: Sequence[float], k: int, ef: int | None = None) -> DataFrame:
        """(rank, id, score, metadata)."""
        return S.with_metadata(self.search(query, k, ef), self.metadata())

    def search_batch(self, queries: DataFrame, k: int, ef: int | None = None) -> DataFrame:
        """(qid, rank, id, score) for ``queries(qid, qv)``; one of another dimension fails the call.

        Exact without ``ef``. With it, and once there is an index, about ``ef`` of the index's vectors are looked at for each
        query, and all that changed since the index was written.
        """
        if ef is None or self._index is None:
            return S.knn_batch(self.live_view(), queries, k, self.metric, self.dimension)
        S.check_queries(queries, self.dimension)
        last = self._since_index()
        if last is None:
            return ann.search(self._index, queries, k, ef)
        old = ann.search(self._index, queries, k, ef, without=last.select("id"))
        new = S.knn_batch(last.where("op = 'INSERT'").select("id", "embedding"), queries, k, self.metric)
        return S.ranked(old.drop("rank").unionByName(new.drop("rank")), k, self.metric)

    # -- the index ---------------------------------------------------------------------------------------------------

    def _since_index(self) -> DataFrame | None:
        """Each id's last change after the index was written."""
        log = self.log()
        return None if log is None else R.last_writer(R.pending(log, self._index.lsn))

    def create_index(self, cells: int | None = None) -> ann.Index:
        """Index the vectors as they are now, in place of any index before; searches with ``ef`` use it from now on.

        Each save brings it up to date: changed vectors go to their cells, and it is built anew when a fifth of it is out of date.
        """
        version = self.meta.index + 1
        built = ann.build(self.live_view(), f"{self.path}/index/v={version}", self.metric, cells, lsn=self.next_lsn - 1)
        before = self.meta.index
        self._publish(replace(self.meta, index=version))
        self._index = built
        if before > 1:
            self.files.delete(f"{self.path}/index/v={before - 1}")
        return built

    def _refresh_index(self) -> None:
        last = self._since_index()
        if last is not None and self._index.lsn < self.next_lsn - 1:
            self._index = self._index.change(last.select("id", "lsn", "embedding"), self.next_lsn - 1)
            if self._index.gone > STALE * self._index.rows:
                self.create_index()

    # -- saving ------------------------------------------------------------------------------------------------------

    def save(self, path: str | None = None) -> None:
        """A new snapshot of vectors, tombstones and metadata, here or as a copy elsewhere.

        The snapshot is written first, then meta.json points to it, then what only the snapshot before needed is dropped; a crash
        in between leaves the old state or the new one, and the log of this folder is only cut when this folder was saved. A
        copy has no index.
        """
        here = path is None or path.rstrip("/") == self.path
        to = self.path if here else path.rstrip("/")
        state = self.state()
        if state is None:
            state = self.spark.createDataFrame([], "id long, embedding array<float>, deleted boolean")
        meta = self.metadata().withColumnRenamed("id", "__mid")
        rows = state.join(meta, state["id"] == meta["__mid"], "full").select(F.coalesce("id", "__mid").alias("id"), "embedding", F.col("deleted"), "metadata")
        version = (self.meta.snapshot if here else 0) + 1
        rows.write.mode("overwrite").parquet(f"{to}/snapshot/v={version}")
        recovery = Recovery(self.next_lsn - 1, self.next_txid - 1, True)
        if not here:
            self.files.write(f"{to}/meta.json", json.dumps(replace(self.meta, recovery=recovery, snapshot=version, index=0).to_json(), indent=2).encode())
            return
        if self._index is not None:
            self._refresh_index()
        before = self.meta.recovery.last_lsn
        self._publish(replace(self.meta, recovery=recovery, snapshot=version))
        self._changes, self._single = [], {}
        for name in self.files.names(f"{self.path}/log"):
            if name.isdigit() and int(name) <= before:
                self.files.delete(f"{self.path}/log/{name}")
        if version > 2:
            self.files.delete(f"{self.path}/snapshot/v={version - 2}")

    def close(self) -> None:
        """Save, if there is a path."""
        if self.persistent:
            self.save()

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
