"""Shared working folder: small intermediate tables are written there once and read back.

A settled table survives the loss of executors, is computed once however often it is joined, and its size is
known, so a broadcast can be decided on facts.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A table is broadcast only up to these measured sizes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Inputs up to this size may be spread over the cores by a shuffle.
SMALL_BYTES = 1024 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    path = context.getCheckpointDir()
    if path is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="evenkeel-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in this application's own folder, which may be removed once the application has ended."""
    own = f"{shared_dir(spark)}/evenkeel/{spark.sparkContext.applicationId}"
    return f"{own}/{label}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for shuffles before work that multiplies the rows."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_system(path: str):
    """Arrow's file system and the path within it of a path in the shared folder, to be used in tasks. Local files are mapped, not read."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    store, place = fs.FileSystem.from_uri(path)
    return (fs.LocalFileSystem(use_mmap=True) if isinstance(store, fs.LocalFileSystem) else store), place


@contextmanager
def _rows_per_batch(spark: SparkSession, rows: int | None) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows is not None and not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame, label: str = "table", rows_per_batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it.

    ``rows_per_batch`` bounds the Arrow batches of this write: whole texts at the default of 10,000 rows take much of a worker's memory.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with _rows_per_batch(spark, rows_per_batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(field: T.StructField) -> Column:
    """Bytes of one value: those of a string, eight per number (four in arrays of 32-bit ones), the JSON text of anything else."""
    value, kind = F.col(field.name), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(value)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.size(value) * (4 if isinstance(kind.elementType, (T.FloatType, T.IntegerType)) else 8)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(value)))
    return F.lit(8)


def measure(settled: DataFrame, *extra: Column) -> tuple:
    """Rows and bytes of a settled table, then the values of further aggregates, in one job."""
    widths = [F.coalesce(_width(f).cast("long"), F.lit(0)) for f in settled.schema]
    size = F.coalesce(F.sum(sum(widths[1:], widths[0])), F.lit(0))
    return tuple(settled.agg(F.count(F.lit(1)), size, *extra).first())


def within_bounds(rows: int, size: int, max_rows: int = BROADCAST_ROWS, max_size: int = BROADCAST_BYTES) -> bool:
    return rows <= max_rows and size <= max_size


def fits_broadcast(settled: DataFrame, max_rows: int = BROADCAST_ROWS, max_size: int = BROADCAST_BYTES) -> bool:
    """True when both the measured rows and the measured bytes of a settled table are within bounds."""
    return within_bounds(*measure(settled), max_rows, max_size)


def spread_small(df: DataFrame, *keys: str, bound: int = SMALL_BYTES) -> DataFrame:
    """Hash a small input over all cores when it lies in fewer files than there are cores.

    A single small Parquet file is read by one task, and costly text work would stay in it. An input above the
    bound is cut finely enough by the scan and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= bound and len(df.inputFiles()) < cores:
        return df.repartition(cores, *keys)
    return df
