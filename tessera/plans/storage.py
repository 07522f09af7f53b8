"""Materialisation in the folder that every executor shares.

A written table cuts lineage and survives the loss of executors, because no
copy lives on an executor's own disk.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scopes: dict[str, list[list[str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if open_scopes := _scopes.get(spark.sparkContext.applicationId):
        open_scopes[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Paths made within the block are deleted at its end, for long sessions; results must have been consumed by then."""
    outer = _scopes.setdefault(spark.sparkContext.applicationId, [])
    outer.append([])
    try:
        yield
    finally:
        for path in outer.pop():
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (``__`` for dots) within the block; former values return after it."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _write(df: DataFrame, path: str, arrow_rows: int | None) -> None:
    """Write ``df``; its shuffle files go at the end, not when the driver happens to collect its garbage."""
    bound = {"spark__sql__execution__arrow__maxRecordsPerBatch": str(arrow_rows)} if arrow_rows else {}
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", **bound):
        df.write.parquet(path)


def written(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it.

    ``arrow_rows`` bounds the rows that Python functions in the plan get at once,
    for tables with long texts.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _write(df, path, arrow_rows)
    return spark.read.schema(df.schema).parquet(path)


def concluded(spark: SparkSession, name: str, build: Callable[[], DataFrame], arrow_rows: int | None = None) -> DataFrame:
    """``written`` for what ``build`` returns; tables that were written on the way to it are deleted."""
    path = new_path(spark, name)
    with scope(spark):
        df = build()
        _write(df, path, arrow_rows)
    return spark.read.schema(df.schema).parquet(path)
