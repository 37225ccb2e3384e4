"""Vectors that arrive as a stream of files, inserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import replay as R
from ..plans.collection import Collection

CHANGES = "lsn long, id long, op string, embedding array<float>"
REJECTED = CHANGES + ", status string, message string"
COMPACT_AFTER = 32


def read_changes(spark: SparkSession, path: str, schema: str = CHANGES, max_files: int = 64) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


class Applied:
    """What streams did to a collection, kept beside it, so that files may come in any order and batches may run again.

    <dir>/applied/b=<stream>-<batch>/changes    the batch's changes that counted, with their source LSNs
    <dir>/applied/b=<stream>-<batch>/rejected   its rows that can't be applied, with their status
    <dir>/applied/b=<stream>-<batch>/done       the changes are in the collection's log
    <dir>/applied/base=<n>                      (id, lsn) of many batches, whose own changes are then dropped

    ``stream`` is a streaming query's id, which its checkpoint keeps, so a query with a new checkpoint counts its batches anew.
    """

    def __init__(self, collection: Collection) -> None:
        self.collection, self.files, self.spark = collection, collection.files, collection.spark
        self.folder = f"{collection.path}/applied"

    def _names(self, kind: str, mark: str) -> list[str]:
        return [n for n in self.files.names(self.folder) if n.startswith(f"{kind}=") and self.files.exists(f"{self.folder}/{n}/{mark}")]

    def marks(self) -> DataFrame | None:
        """(id, lsn): the largest source LSN applied to each id; None before the first batch."""
        paths = [f"{self.folder}/{n}/changes" for n in self._names("b", "done")] + [f"{self.folder}/{n}" for n in self._names("base", "_SUCCESS")]
        return self.spark.read.schema("id long, lsn long").parquet(*paths).groupBy("id").agg(F.max("lsn").alias("lsn")) if paths else None

    def apply(self, batch: DataFrame, number: int, stream: str | None = None) -> None:
        """One batch: of each id the valid change with the largest LSN, if that is larger than any applied to the id before."""
        stream = stream or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "0"
        here = f"{self.folder}/b={stream}-{number:010d}"
        if self.files.exists(f"{here}/done"):
            return
        if not self.files.exists(f"{here}/changes/_SUCCESS"):
            self._decide(batch, here)
        changes = self.spark.read.schema(CHANGES).parquet(f"{here}/changes")
        self.collection.apply_batch(changes, "lsn")
        self.files.write(f"{here}/done", b"")
        if len(self._names("b", "done")) > COMPACT_AFTER:
            self.compact()

    def _decide(self, batch: DataFrame, here: str) -> None:
        rows = R.batch_status(batch.select("lsn", F.col("id").cast("long").alias("id"), "op", "embedding"), self.collection.dimension)
        known = F.col("id").isNotNull() & F.col("lsn").isNotNull() & F.col("op").isin(*R.REPLAYED)
        good = known & ((F.col("op") == "DELETE") | (F.col("status") == "kOk"))
        rows = rows.persist()
        try:
            message = F.when(known, F.col("message")).otherwise("a change needs an id, an lsn and an operation")
            bad = rows.where(~good | good.isNull()).withColumns({"status": F.when(known, F.col("status")).otherwise("kInvalidArgument"), "message": message})
            bad.select("lsn", "id", "op", "embedding", "status", "message").write.mode("overwrite").parquet(f"{here}/rejected")
            last = rows.where(good).groupBy("id").agg(F.max_by(F.struct("lsn", "op", "embedding"), "lsn").alias("c")).select("id", "c.*")
            marks = self.marks()
            if marks is not None:
                last = last.join(marks.withColumnRenamed("lsn", "mark"), "id", "left").where("mark IS NULL OR lsn > mark")
            last.select("lsn", "id", "op", F.when(F.col("op") == "INSERT", F.col("embedding")).alias("embedding")).write.mode("overwrite").parquet(f"{here}/changes")
        finally:
            rows.unpersist()

    def compact(self) -> None:
        """One table of marks in place of all others; each stream's last batch is kept, as it may be asked for again."""
        done, bases = self._names("b", "done"), self._names("base", "_SUCCESS")
        number = max((int(n.split("=")[1]) for n in bases), default=0) + 1
        self.marks().write.mode("overwrite").parquet(f"{self.folder}/base={number:010d}")
        last = {n.rsplit("-", 1)[0]: n for n in sorted(done)}
        for n in done:
            if n not in last.values():
                self.files.delete(f"{self.folder}/{n}/done")
                self.files.delete(f"{self.folder}/{n}/changes")
        for n in bases:
            self.files.delete(f"{self.folder}/{n}")

    def rejected(self) -> DataFrame:
        """(lsn, id, op, embedding, status, message): all rows that could not be applied."""
        paths = [f"{self.folder}/{n}/rejected" for n in self.files.names(self.folder) if n.startswith("b=") and self.files.exists(f"{self.folder}/{n}/rejected/_SUCCESS")]
        return self.spark.read.schema(REJECTED).parquet(*paths) if paths else self.spark.createDataFrame([], REJECTED)


def into_collection(changes: DataFrame, collection: Collection, checkpoint: str) -> StreamingQuery:
    """Apply ``changes(lsn, id, op, embedding)`` as they come.

    Of the changes of an id the one with the largest LSN counts, in whatever order the files arrive and however they fall into
    batches. A batch that runs again after a failure is the same batch, and does nothing if it was done. Rows with a vector
    of another size, or without an id, an LSN or a known operation, are kept for ``Applied(collection).rejected()``.
    """
    return changes.writeStream.foreachBatch(Applied(collection).apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(changes: DataFrame, time_col: str = "ts", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(begin, op, n): changes by window and operation; works on a stream, where later rows than ``delay`` are dropped, and on a table."""
    return changes.withWatermark(time_col, delay).groupBy(F.window(time_col, window), "op").agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), "op", "n")
