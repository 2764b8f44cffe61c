"""Class counts, imbalance and what a dataset needs to be balanced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.labels import is_labelled
from evenkeel.operators.joining import compare


def class_distribution(df: DataFrame, by: Sequence[str] = ("dataset_id",), label: str = "label") -> DataFrame:
    """Rows per label."""
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def imbalance_summary(
    df: DataFrame, by: Sequence[str] = ("dataset_id",), label: str = "label", strict: bool = False
) -> DataFrame:
    """Total, smallest and largest class and their ratio over all splits together; one class gives 1.0.

    Unlabelled rows are left out. ``strict`` makes an input without a labelled row an error.
    """
    labelled = df.where(is_labelled(F.col(label)))
    if strict and labelled.isEmpty():
        raise ValueError("no labelled rows to profile")
    counts = class_distribution(labelled, by, label)
    return counts.groupBy(*by).agg(
        F.sum("n").alias("total"),
        F.min("n").alias("minority"),
        F.max("n").alias("majority"),
        (F.max("n") / F.min("n")).alias("imbalance_ratio"),
    )


def distribution_entry(df: DataFrame, by: Sequence[str] = ("dataset_id",), label: str = "label") -> DataFrame:
    """One row per dataset: a map of label to count, the total and the ratio."""
    counts = class_distribution(df.where(is_labelled(F.col(label))), by, label)
    entries = F.sort_array(F.collect_list(F.struct(F.col(label).cast("string").alias("key"), "n")))
    return counts.groupBy(*by).agg(
        F.map_from_entries(entries).alias("counts"),
        F.sum("n").alias("total"),
        (F.max("n") / F.min("n")).alias("imbalance_ratio"),
    )


def class_shares(df: DataFrame, by: Sequence[str] = ("dataset_id",), label: str = "label") -> DataFrame:
    """Count and percent of each class; the window runs over the counts, not over the rows."""
    total = F.sum("n").over(Window.partitionBy(*by))
    return class_distribution(df, by, label).withColumn("percent", 100.0 * F.col("n") / total)


def balance_need(
    df: DataFrame, by: Sequence[str] = ("dataset_id",), label: str = "label", row: str = "row_id"
) -> DataFrame:
    """Rarest label, largest class size and how many rows the rarest class lacks.

    Classes of equal size are told apart by which label comes first in the data.
    """
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("_first"))
    return counts.groupBy(*by).agg(
        F.min_by(label, F.struct("n", "_first")).alias("minority_label"),
        F.min("n").alias("minority_count"),
        F.max("n").alias("majority_count"),
        (F.max("n") - F.min("n")).alias("needed"),
        F.count(F.lit(1)).alias("n_classes"),
    )


def before_after_counts(
    before: DataFrame, after: DataFrame, by: Sequence[str] = ("dataset_id",), label: str = "label"
) -> DataFrame:
    """Class counts on both sides of a balancing step."""
    both = compare(
        class_distribution(before, by, label),
        class_distribution(after, by, label),
        [*by, label],
        ("before", "after"),
    )
    return both.select(
        *by,
        label,
        F.coalesce("before__n", F.lit(0)).alias("n_before"),
        F.coalesce("after__n", F.lit(0)).alias("n_after"),
    )
