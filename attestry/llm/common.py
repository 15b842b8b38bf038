"""Shared storage for intermediate tables, and small column helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and the ASCII controls from tab to carriage return.
WS = "[\\x20\\x09-\\x0D]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a folder of its own; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor costs only the tasks that ran on it: what was written stays readable.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestry-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{tag}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attestry_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


#: Tables staged inside each open ``scratch``.
_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch():
    """Delete what is staged inside on leaving, but for tables given to the ``keep`` that this yields.

    What is kept belongs to the scratch around, if there is one. Only tables that nothing lazy reads any more
    may be left to it.
    """
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.pop()
        discard(*(t for t in made if not any(t is k for k in kept)))
        if _scopes:
            _scopes[-1].extend(kept)


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has staged. Results that were not written yet cannot be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/attestry-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._attestry_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_worker() -> None:
    """Hand back what a Python worker holds: workers outlive their tasks, and share an executor's memory with the JVM."""
    from . import bpe, shingles

    shingles.forget_powers()
    bpe.forget_words()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which leaves nothing behind in its worker when the task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            free_worker()

    return tidied


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null and empty texts."""
    edge = lambda p: F.when(text.rlike(p), 1).otherwise(0)
    n = F.size(F.split(text, WS + "+")) - edge("\\A" + WS) - edge(WS + "\\z")
    return F.when(text.isNull() | (F.length(text) == 0), F.lit(0)).otherwise(n).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
