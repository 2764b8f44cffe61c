"""Balancing by duplication and by random undersampling; all datasets in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.constants import SEED
from evenkeel.functions.labels import HASH_DOMAIN, hash_order
from evenkeel.operators.joining import attach_settled
from evenkeel.operators.profile import balance_need
from evenkeel.operators.ranking import CELL_ROWS, exact_cuts, first_n
from evenkeel.workspace import measure, settle, shuffle_partitions, within_bounds

# Copies of one row that one task may write in a row.
COPY_CHUNK = 10_000


def _repeat(rows: DataFrame, last: Column) -> DataFrame:
    """One row per copy, numbered from ``_from`` to ``last``."""
    return rows.withColumn("copy", F.explode(F.sequence(F.col("_from"), last)))


def duplicate_minority(
    df: DataFrame,
    label: str = "label",
    order_by: str = "row_id",
    cell_rows: int = CELL_ROWS,
    chunk: int = COPY_CHUNK,
) -> DataFrame:
    """Raise the rarest class of every dataset to the size of the largest by repeating its rows.

    Every minority row is repeated floor(needed / count) times, and the first (needed mod count) rows in
    dataset order once more. ``copy`` numbers the repetitions, 0 being the original. A dataset with one class
    or with equal classes stays as it is. One scan writes all copies and rows are not shuffled, unless a row is
    to be repeated more than ``chunk`` times: then its copies are shared out over the tasks in chunks.
    """
    by = ["dataset_id"]
    need = settle(balance_need(df, by, label, order_by).where(F.col("needed") > 0), "need")
    plan = need.select(
        *by,
        F.col("minority_label").alias("_rare"),
        F.expr("needed div minority_count").alias("_copies"),
        F.expr("needed % minority_count").alias("k"),
    )
    n_plans, size, most = measure(plan, F.max("_copies"))
    fits = within_bounds(n_plans, size)
    columns, order = df.columns, F.col(order_by)
    # Ordering other rows behind the minority's lets one search run over the rows as they are.
    rare = attach_settled(df, plan.select(*by, "_rare"), by, "left", fits=fits)
    other = F.coalesce(F.col(label) != F.col("_rare"), F.lit(True)).cast("long")
    rare, cuts, first = exact_cuts(rare, by, other, order, plan.select(*by, "k"), cell_rows)
    lookup = settle(plan.drop("k", "_rare").join(cuts, by, "left"), "plan")
    planned = attach_settled(rare, lookup, by, "left", fits=fits)
    repeats = F.when(F.col(label) == F.col("_rare"), F.col("_copies") + first.cast("long"))
    planned = planned.select(*columns, F.coalesce(repeats, F.lit(0).cast("long")).alias("_last"))
    start = planned.withColumn("_from", F.lit(0).cast("long"))
    if most is None or most < chunk:
        return _repeat(start, F.col("_last")).select(*columns, "copy")
    few = _repeat(start.where(F.col("_last") < chunk), F.col("_last"))
    pieces = F.transform(F.sequence(F.lit(0), F.expr(f"_last div {chunk}")), lambda c: c * chunk)
    partitions = shuffle_partitions(planned.sparkSession)
    many = planned.where(F.col("_last") >= chunk).withColumn("_from", F.explode(pieces))
    many = many.repartition(partitions, *by, order_by, "_from")
    many = _repeat(many, F.least(F.col("_last"), F.col("_from") + (chunk - 1)))
    return few.select(*columns, "copy").unionByName(many.select(*columns, "copy"))


def undersample_random(
    df: DataFrame,
    label: str = "label",
    seed: int = SEED,
    row: str = "row_id",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Cut every larger class at random to the size of the rarest; the seed decides which rows stay."""
    need = settle(balance_need(df, ["dataset_id"], label, row), "need")
    counts = df.groupBy("dataset_id", label).agg(F.count(F.lit(1)).alias("_n"))
    quota = counts.join(need.select("dataset_id", F.col("minority_count").alias("k")), "dataset_id")
    order = hash_order(seed, F.col(row))
    by = ["dataset_id", label]
    return first_n(df, by, order, F.col(row), quota.drop("_n"), cell_rows, HASH_DOMAIN)
