"""Runtime control: caching, partitioning, settings, plans, the file system."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tessera.plans.storage import settings, shared_dir

__all__ = ["Files", "cached", "checkpointed", "plan_text", "settings"]


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """``df`` persisted within the block and released after it."""
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the cluster names; never a local one."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What ``explain`` prints, as text."""
    jvm = df.sparkSession.sparkContext._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


class Files:
    """File operations through Hadoop, so that they reach any store."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def ls(self, path: str) -> list[tuple[str, int, bool]]:
        """(name, bytes, is folder), sorted."""
        fs, p = self._at(path)
        return sorted((s.getPath().getName(), s.getLen(), s.isDirectory()) for s in fs.listStatus(p))

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def put(self, path: str, text: str, overwrite: bool = False) -> None:
        fs, p = self._at(path)
        out = fs.create(p, overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def head(self, path: str, size: int = 65536) -> str:
        """The first ``size`` bytes as text."""
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, fs.getFileStatus(p).getLen()))).decode(errors="replace")
        finally:
            stream.close()

    def cp(self, source: str, target: str) -> None:
        (a, p), (b, q) = self._at(source), self._at(target)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, self._conf)

    def mv(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        if not fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(target)):
            raise OSError(f"{source} cannot become {target}")

    def rm(self, path: str, recurse: bool = False) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, recurse)
