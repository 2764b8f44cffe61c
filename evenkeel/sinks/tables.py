"""Tables of examples, generated rows and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators.joining import attach
from evenkeel.sinks.files import partition_values

ROWS_PER_FILE = 50_000
DATASET_KEYS = ("strategy", "dataset_id", "split")


def write_dataset(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def stored_keys(spark: SparkSession, root: str, keys: Sequence[str] = DATASET_KEYS) -> DataFrame:
    """The keys stored under ``root``, as texts, from the names of their folders; no file is opened."""
    schema = ", ".join(f"`{k}` string" for k in keys)
    return spark.createDataFrame(partition_values(spark, root, list(keys)), schema)


def materialise(df: DataFrame, root: str, keys: Sequence[str] = DATASET_KEYS, order: str | None = None) -> None:
    """Write the datasets that are not there yet, one folder per key; present ones stay untouched.

    Without ``order`` rows are rebalanced by key, so small datasets end in one file each and a huge one is split over many tasks. With it, rows
    are sorted by key and ``order`` in ranges that become files: a key's files, by the number in their names, hold its rows in order.
    """
    keys = list(keys)
    present = stored_keys(df.sparkSession, root, keys)
    if not present.isEmpty():
        typed = [F.col(k).cast(df.schema[k].dataType).alias(k) for k in keys]
        df = attach(df, present.select(*typed), keys, "left_anti")
    dealt = df.hint("rebalance", *keys) if order is None else df.orderBy(*keys, order)
    dealt.write.mode("append").partitionBy(*keys).parquet(root)


def replace_keys(df: DataFrame, root: str, keys: Sequence[str] = DATASET_KEYS, order: str | None = None) -> None:
    """Write the datasets of ``df``, replacing what an interrupted run left in their folders; other folders stay."""
    keys = list(keys)
    dealt = df.hint("rebalance", *keys) if order is None else df.orderBy(*keys, order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(root)


def append_generated(generated: DataFrame, log_path: str) -> None:
    """Append to the generation log. An append is committed as a whole, so an interrupted one leaves nothing.

    Folders are by pass only: passes are at most 15, while a folder per dataset as well would give every task
    a file for each dataset it meets.
    """
    columns = ["dataset_id", "src_id", "text", "label", "pass"]
    generated.select(*columns).write.mode("append").partitionBy("pass").parquet(log_path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.json(path)
