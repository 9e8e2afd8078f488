"""Session helpers the training-data operators share.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, as
Parquet written by Spark's committer: every executor can read them, a lost
executor loses none of them, and reading one back cuts the lineage.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch handed to Python; texts are long, so far below Spark's default.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a full URI.

    Where none is named a session on this machine alone (tests) gets a folder of
    its own; on a cluster that would be another one on each node, so it is an error.
    """
    context = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not told:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        context.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), "framelake-checkpoints"))
        told = context.getCheckpointDir()
    # a path without a scheme is one of the cluster's default file system, as Spark takes it
    path = context._jvm.org.apache.hadoop.fs.Path(told)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


#: Paths that this driver made in the shared folder.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    _made.append(f"{shared_dir(spark)}/framelake/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> list[str]:
    """Paths in the shared folder that this driver made and has not deleted, the oldest first."""
    return list(_made)


def sweep(spark: SparkSession, keep: Iterable[str] = ()) -> int:
    """Delete what this driver wrote to the shared folder but for the paths in ``keep``.

    For a job that has written its results elsewhere, or a step whose result is a
    table that is kept: anything else that is still to be read is lost.  Returns
    how many paths were deleted.
    """
    context, gone, kept = spark.sparkContext, 0, [p for p in _made if p in set(keep)]
    for made in [p for p in _made if p not in kept]:
        path = context._jvm.org.apache.hadoop.fs.Path(made)
        gone += path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    _made[:] = kept
    return gone


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of long texts small, from now on: a plan asks for the setting when it runs."""
    spark.conf.set(_BATCH, str(BATCH_ROWS))


@contextlib.contextmanager
def large_batches(spark: SparkSession, rows: int = 1 << 16):
    """Larger batches for what runs inside: rows of a few numbers."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def release() -> None:
    """Give memory that is free but held by the allocators back; a worker otherwise keeps the most it ever had."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:  # another C library
        return None


_LIBC = _libc()


def frugal(f):
    """A function of Arrow batches that releases memory when a task is over: idle workers count in an executor's memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def regrouped(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of ``column``; a longer single value stays whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= max_bytes:
            yield _joined(held)
            held, size = [], 0
            release()
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI in the shared folder; a bare path is a local one."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
