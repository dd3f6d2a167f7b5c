"""Storage that the driver and every executor can reach.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``.  A
written table cuts lineage the way ``checkpoint()`` does, but its plan runs only
once, and a lost executor costs a re-read instead of a recomputation.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tidemark-shared-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def delete(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables whose readers have all been written."""
    for df in tables:
        _written.remove(df._written_to)
        delete(df.sparkSession, df._written_to)


def release(spark: SparkSession) -> int:
    """Delete every intermediate table of this process; results that still read them become invalid."""
    n = 0
    while _written:
        n += delete(spark, _written.pop())
    return n


def text_key(text_col: str = "text") -> Column:
    """Tells texts under one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def leave_out(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) whose id and text key are not in ``rows`` (doc_id, text_key).

    So a decision on a text leaves other texts under its id alone, and null ids count like any other.
    """
    none = F.lit(-(1 << 63))
    names = [next(f"{n}{i}" for i in range(len(docs.columns) + 1) if f"{n}{i}" not in docs.columns) for n in ("left_id", "left_key")]
    gone = rows.select(F.coalesce("doc_id", none).alias(names[0]), F.col("text_key").alias(names[1])).distinct()
    return docs.withColumns({names[0]: F.coalesce(F.col("doc_id").cast("long"), none), names[1]: text_key()}).join(gone, names, "left_anti").select(docs.columns)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function that gives memory back to the system when its task ends: workers are used again by the
    stages that follow, and what one of them holds would count against all."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import tokens

        tokens.forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except OSError:  # another C library
                pass

    return tidied
