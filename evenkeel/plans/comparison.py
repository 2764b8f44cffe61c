"""Result tables across strategies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.joining import keep_complete
from evenkeel.operators.metrics import measured_only, speedup


def strategy_comparison(
    metrics: DataFrame, strategies: Sequence[str], values: Sequence[str] = ("macro_f1", "tpr_gap"), digits: int = 4
) -> DataFrame:
    """Full outer join of the strategies' metrics, one row per dataset, rounded."""

    def side(strategy: str) -> DataFrame:
        named = [F.round(v, digits).alias(f"{strategy}__{v}") for v in values]
        return metrics.where(F.col("strategy") == strategy).select("dataset_id", *named)

    joined = reduce(lambda a, b: a.join(b, "dataset_id", "full_outer"), [side(s) for s in strategies])
    return joined.orderBy("dataset_id")


def timed_comparison(comparison: DataFrame, runs: DataFrame, method: str) -> DataFrame:
    """Comparison rows whose jobs were measured under the baseline and the method; all if there are none."""
    ratios = speedup(measured_only(runs)).where(F.col("strategy") == method)
    complete = ratios.select(F.col("job_id").alias("dataset_id")).distinct()
    return keep_complete(comparison, complete, ["dataset_id"])
