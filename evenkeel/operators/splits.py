"""Exact, reproducible splits. The order is a hash of seed and row id, so any engine can repeat it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.constants import SEED, TRAIN_RATIO, VALIDATION_FRACTION
from evenkeel.functions.labels import HASH_DOMAIN, hash_order
from evenkeel.operators.joining import attach
from evenkeel.operators.ranking import mark_first

VALIDATION_SALT = "val"


def _columns(row: str | Sequence[str]) -> list[Column]:
    return [F.col(row)] if isinstance(row, str) else [F.col(c) for c in row]


def _split(df: DataFrame, quota: Column, order: Column, row: str | Sequence[str], chosen: str, rest: str, name: str) -> DataFrame:
    tie = F.col(row) if isinstance(row, str) else F.xxhash64(*row)
    marked = mark_first(df, ["dataset_id"], order, tie, quota, "_chosen", domain=HASH_DOMAIN)
    return marked.withColumn(name, F.when(F.col("_chosen"), chosen).otherwise(rest)).drop("_chosen")


def train_test_split(
    df: DataFrame, train_ratio: float = TRAIN_RATIO, seed: int = SEED, row: str = "row_id"
) -> DataFrame:
    """Add ``split``: exactly ceil(n * (1 - ratio)) test rows per dataset, not stratified."""
    # Rounding keeps 10 * (1 - 0.8) at 2 where binary arithmetic would make the ceiling 3.
    quota = F.ceil(F.round(F.col("n") * F.lit(1 - train_ratio), 6))
    return _split(df, quota, hash_order(seed, F.col(row)), row, "test", "train", "split")


def train_val_split(
    train: DataFrame, fraction: float = VALIDATION_FRACTION, seed: int = SEED, row: str | Sequence[str] = "row_id"
) -> DataFrame:
    """Add ``part``: exactly max(1, floor(n * fraction)) validation rows per dataset.

    ``row`` names the columns that tell rows apart: for a balanced part also ``copy`` or ``pass``, or else all copies of
    a row come one after the other in the order.
    """
    quota = F.greatest(F.lit(1), F.floor(F.round(F.col("n") * F.lit(fraction), 6)))
    order = hash_order(seed, F.lit(VALIDATION_SALT), *_columns(row))
    return _split(train, quota, order, row, "val", "train", "part")


def resolve_splits(df: DataFrame, train_ratio: float = TRAIN_RATIO, seed: int = SEED) -> DataFrame:
    """Use a dataset's own train and test parts; split it when it has only train rows or no parts.

    A dataset with neither is an error. Other parts are dropped.
    """
    name = F.coalesce(F.col("split"), F.lit("train"))
    has_train, has_test = F.max(name == "train"), F.max(name == "test")
    known = F.when(has_train, has_test).otherwise(F.raise_error(F.lit("dataset has no usable split")))
    shape = df.groupBy("dataset_id").agg(known.alias("_native"))
    placed = attach(df.withColumn("split", name), shape, ["dataset_id"])
    native = placed.where(F.col("_native") & F.col("split").isin("train", "test")).drop("_native")
    flat = placed.where(~F.col("_native") & (F.col("split") == "train")).drop("_native", "split")
    return native.unionByName(train_test_split(flat, train_ratio, seed))
