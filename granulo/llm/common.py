"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that is worked on at a time inside a Python worker, as arrays of many bytes a byte or as strings; one longer document is a chunk of its own.
#: Some whole-array steps take about 100 bytes a byte of text.
CHUNK_BYTES = 1 << 19
#: Bytes that go to a Python worker at a time.
BATCH_BYTES = 2 << 20

#: What a Python worker keeps from task to task of one stage, and that stage.
_held: dict = {}
_stage: list[int | None] = [None]


def held(key, make: Callable):
    """``make()``, made once for the tasks that a Python worker runs of one stage."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def worker(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow``: what tasks of other stages hold in the worker goes first, freed memory goes back to the system at the end.

    Workers are used again by later stages, and memory that one keeps counts against its executor all that time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stage = task.stageId() if task else None
        if stage != _stage[0]:
            _held.clear()
            _stage[0] = stage
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def in_arrow(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``rows.mapInArrow`` of ``work`` as ``worker`` makes it, over batches of at most BATCH_BYTES, or of one larger row.

    The bound is a setting of the session and stays there, as the rows may be asked for later; one that was set before holds. Spark's own is
    64 MB, and the buffers of such batches take hundreds of megabytes beside an executor's heap.
    """
    conf = rows.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, f"{64 << 20}b").removesuffix("b") == str(64 << 20):
        conf.set(name, f"{BATCH_BYTES}b")
    return rows.mapInArrow(worker(work), schema)


def give_back() -> None:
    """Returns freed memory to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local master, where there is one machine, gets a folder of its own when the setting is absent.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = spark.sparkContext.getCheckpointDir()
        if set_before:
            return os.path.dirname(set_before)
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs a read and not a recomputation.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` the files go when no plan refers to them any more; else they stay
    until the folder is cleared. For small tables; ``Scratch`` is for large ones.
    """
    spark = df.sparkSession
    shared = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    with shuffles_end(spark):
        return df.checkpoint(eager=True)


@contextmanager
def shuffles_end(spark: SparkSession):
    """Within it, the shuffle files of an action go when the action ends, whenever a collector runs on the driver."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables in the shared folder that last as long as the ``with`` block: what a step needs more than once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` computed once; a lost executor costs a read and not a recomputation."""
        self.paths.append(shared_path(self.spark, name))
        return written(df, self.paths[-1])

    def drop(self) -> None:
        """Removes what is kept so far."""
        while self.paths:
            remove(self.spark, self.paths.pop())


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``, whose shuffles go at once."""
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of a string column and where each row begins there, without copying. Null rows have no bytes."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    kind = np.int32 if pa.types.is_string(column.type) else np.int64
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, kind)[column.offset : column.offset + len(column) + 1] if bounds else np.zeros(1, kind)
    return np.frombuffer(data or b"", np.uint8), bounds


def _cuts(bounds: np.ndarray, limit: int):
    at, rows = 0, len(bounds) - 1
    while at < rows:
        end = min(max(at + 1, int(np.searchsorted(bounds, int(bounds[at]) + limit, "right")) - 1), rows)
        yield at, end
        at = end


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """``(first row, bytes, offsets)`` of consecutive rows: their UTF-8 in one array and where each row begins, nulls being empty."""
    data, bounds = _buffers(column)
    for at, end in _cuts(bounds, limit):
        yield at, data[bounds[at] : bounds[end]], (bounds[at : end + 1] - bounds[at]).astype(np.int64)


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = 2 * CHUNK_BYTES):
    """The batch in consecutive slices of at most ``limit`` bytes in column ``name``, one row at least."""
    _, bounds = _buffers(batch.column(name))
    for at, end in _cuts(bounds, limit):
        yield batch.slice(at, end - at)
