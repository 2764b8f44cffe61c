"""Scores of predictions. Every metric is derived from one count per (y_true, y_pred)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("dataset_id", "strategy")


def prediction_cells(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs of true and predicted label with their counts: the only pass over the predictions."""
    return df.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def label_scores(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per label occurring on either side: hits, support, predictions, precision, recall and F1."""
    label = F.explode(F.array_distinct(F.array("y_true", "y_pred"))).alias("label")
    sides = prediction_cells(df, keys).select("*", label)
    is_true, is_pred = F.col("y_true") == F.col("label"), F.col("y_pred") == F.col("label")
    per_label = sides.groupBy(*keys, "label").agg(
        _total(is_true & is_pred).alias("tp"),
        _total(is_true).alias("support"),
        _total(is_pred).alias("predicted"),
        _total(is_true & F.col("y_pred").isin(0, 1)).alias("binary_support"),
    )
    return per_label.select(
        "*",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def confusion_matrix(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts on labels 0 and 1; pairs with any other label are left out.

    A group whose true labels hold neither 0 nor 1 is an error.
    """
    cell = {f"c{t}{p}": _total((F.col("y_true") == t) & (F.col("y_pred") == p)) for t in (0, 1) for p in (0, 1)}
    out = prediction_cells(df, keys).groupBy(*keys).agg(
        *[value.alias(name) for name, value in cell.items()],
        _total(F.col("y_true").isin(0, 1)).alias("_known"),
    )
    return out.select(*keys, *[_guard(F.col(name), F.col("_known")).alias(name) for name in cell])


def _guard(value: Column, known: Column) -> Column:
    return F.when(known == 0, F.raise_error(F.lit("no true label is 0 or 1"))).otherwise(value)


def macro_f1(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Unweighted mean of F1 over the labels that occur as truth or as prediction."""
    return label_scores(df, keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def fairness_report(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Accuracy, Macro-F1, true positive rate per class and their gap.

    A class that does not occur has rate 0.0. A group whose true labels hold neither 0 nor 1 is an error.
    """
    scores = label_scores(df, keys)

    def rate(label: int) -> Column:
        hits = F.coalesce(F.sum(F.when(F.col("label") == label, F.col("tp"))), F.lit(0))
        support = F.coalesce(F.sum(F.when(F.col("label") == label, F.col("binary_support"))), F.lit(0))
        return _ratio(hits, support)

    known = F.sum(F.when(F.col("label").isin(0, 1), F.col("support")).otherwise(0))
    out = scores.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        rate(0).alias("tpr_class_0"),
        rate(1).alias("tpr_class_1"),
        known.alias("_known"),
    )
    return out.select(
        *keys,
        _guard(F.col("accuracy"), F.col("_known")).alias("accuracy"),
        "macro_f1",
        "tpr_class_0",
        "tpr_class_1",
        F.abs(F.col("tpr_class_0") - F.col("tpr_class_1")).alias("tpr_gap"),
    )


def class_precision_recall(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Precision and recall of the largest and the rarest true class."""
    scores = label_scores(df, keys).where(F.col("support") > 0)
    size = F.struct("support", "label")
    value = F.struct("label", "precision", "recall")
    # On equal support the majority is the larger label and the minority the smaller, so they differ.
    out = scores.groupBy(*keys).agg(F.max_by(value, size).alias("most"), F.min_by(value, size).alias("least"))
    return out.select(
        *keys,
        F.col("most.label").alias("majority_label"),
        F.col("most.precision").alias("precision_majority"),
        F.col("most.recall").alias("recall_majority"),
        F.col("least.label").alias("minority_label"),
        F.col("least.precision").alias("precision_minority"),
        F.col("least.recall").alias("recall_minority"),
    )


def speedup(
    runs: DataFrame,
    keys: Sequence[str] = ("job_id",),
    baseline: str = "baseline",
) -> DataFrame:
    """Baseline seconds over each other strategy's seconds, for jobs measured under both."""
    keys = list(keys)
    base = runs.where(F.col("strategy") == baseline).select(
        *keys, F.col("elapsed_seconds").alias("baseline_seconds")
    )
    others = runs.where(F.col("strategy") != baseline).select(
        *keys, "strategy", F.col("elapsed_seconds").alias("method_seconds")
    )
    return others.join(base, keys, "inner").withColumn(
        "speedup", F.round(F.try_divide(F.col("baseline_seconds"), F.col("method_seconds")), 3)
    )


def measured_only(runs: DataFrame) -> DataFrame:
    """Runs that succeeded and whose time was measured, not estimated."""
    return runs.where(F.col("success") & (F.col("elapsed_source") == "measured"))
