"""Shared helpers of the training-data operators: tables, shared scratch space, bounded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a private one only in local mode where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="framewise-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark's setting that removes the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of how many rows are sent to a Python worker at once.
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def _with_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again. The write's shuffle files go at once.

    rows: how many rows go to a Python worker at once meanwhile, where they are large.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _with_settings(spark, {_CLEANUP: "true"} | ({_BATCH_ROWS: str(rows)} if rows else {})):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more.

    Only for frames whose every reader has itself been materialized; a lost executor then recomputes nothing here.
    """
    spark = frames[0].sparkSession
    for frame in frames:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def reading(df: DataFrame, *frames: DataFrame) -> DataFrame:
    """df, with note of the materialized tables that it reads: who has written df may let go of them."""
    df._held = frames
    return df


def release(df: DataFrame) -> None:
    """Delete the tables that df reads; for a df whose rows have been written, and that nothing reads any more."""
    if frames := getattr(df, "_held", ()):
        discard(*frames)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, in any casing."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _trim() -> None:
    """Give the memory that a task has freed back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call in this C library
        pass


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, for mapInArrow and applyInArrow, that frees its worker's memory when it has ended."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        _trim()

    return run


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(work, schema) on workers that have this package's source and give back what memory they used."""
    ship(df.sparkSession)
    return df.mapInArrow(trimmed(work), schema)


@contextlib.contextmanager
def no_gc() -> Iterator[None]:
    """No search for cycles meanwhile: where none are made, scanning a large cache for them takes long."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within limit; else unhinted, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column.to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that what a batch is turned into stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
