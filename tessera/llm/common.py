"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder serves in local mode; on a
    cluster that is an error, since executors would not share it.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


class Scratch:
    """Intermediate Parquet tables in the shared folder, dropped on exit.

    Writing a table cuts lineage and survives the loss of executors.  What an
    operator returns must not read them: pass results through :meth:`keep`, whose
    checkpoint files Spark deletes when the result is no longer referenced.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        delete_path(self.spark, self.root)

    def path(self) -> str:
        self._n += 1
        return f"{self.root}/{self._n}"

    def table(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of one scratch table."""
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_path(self.spark, file)

    def release(self) -> None:
        """Let Spark delete shuffle files of what is no longer referenced, which it does when objects are collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    @staticmethod
    def keep(df: DataFrame) -> DataFrame:
        # Looked up when a checkpoint is made; by default such files stay for ever.
        df.sparkSession.sparkContext._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        return df.checkpoint()


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def quoted(name: str) -> str:
    """A column's name for :func:`pyspark.sql.functions.col`, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that identify a text, as two longs (fixed width keeps hash aggregation)."""
    return F.xxhash64(text), F.xxhash64(F.lit("tessera"), text)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its values (nulls are empty)."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of values of about ``limit`` bytes each; one value is never split."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives its memory back at the end: Python workers live on, idle or for the next stage, beside the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Return freed memory to the system, as far as its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # the C library has no such call


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def ensure_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail early, and by name, where an input lacks a column; see to it that executors have this package."""
    ship(df.sparkSession)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"input lacks the columns {missing}; it has {df.columns}")
    return df
