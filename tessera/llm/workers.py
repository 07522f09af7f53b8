"""What the operators share: keys of rows, and helpers of Python workers on the executors."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents that are handed to Python at once.
BATCH_ROWS = 512


def give_back() -> None:
    """Return freed memory to the system at a task's end; a worker lives on, and its idle memory would add to the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def row_key(df: DataFrame) -> Column:
    """64-bit hash of all columns of a row, nulls included; maps, which Spark can't hash, count by their entries.

    Ids may be null or repeat, so decisions on rows go by this key: rows that share it are equal.
    """
    parts = [F.col(f"`{f.name}`") for f in df.schema.fields]
    # xxhash64 passes over nulls, so which columns are null is hashed too
    whole = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(parts, df.schema.fields, strict=True)]
    return F.xxhash64(*whole, F.array(*[c.isNull() for c in parts]))


def spread(df: DataFrame, per_core: int = 4 << 20) -> DataFrame:
    """A small table dealt to all cores, for row-local work that costs far more than its reading; others as they are.

    A file of one row group is one task however long its rows take.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * per_core else df
