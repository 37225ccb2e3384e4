"""Small files and folders through Hadoop's file systems, so that any path Spark reads works; and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def names(self, path: str) -> list[str]:
        """What a folder holds, sorted; nothing if there is no folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def whole(self, path: str) -> list[str]:
        """Names of a folder's subfolders whose Spark write was finished, sorted; by one listing."""
        fs, p = self._at(f"{path}/*/_SUCCESS")
        return sorted(s.getPath().getParent().getName() for s in fs.globStatus(p) or [])

    def files(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of a file, or of a folder's visible files by name."""
        fs, p = self._at(path)
        found = fs.listStatus(p)
        return sorted((s.getPath().toString(), s.getLen()) for s in found if s.isFile() and s.getPath().getName()[0] not in "._")

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """Write beside the target, then rename over it, so that a reader finds the old file or the new one."""
        fs, p = self._at(path)
        beside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(beside, True)
        try:
            out.write(data)
            out.hsync()
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(beside, p, options)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets a temporary folder, a cluster's an error."""
    sc = spark.sparkContext
    here = sc._jsc.sc().getCheckpointDir()
    if here.isDefined():
        return here.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vexmark-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A fresh path in the session's shared folder."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, whatever executors are lost later."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
