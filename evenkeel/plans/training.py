"""A text classifier per dataset and strategy, judged on the untouched test part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.text import ws_tokens
from evenkeel.operators.joining import attach_settled
from evenkeel.workspace import settle


def bayes_predictions(train: DataFrame, test: DataFrame) -> DataFrame:
    """Predictions of a naive Bayes classifier per (dataset_id, strategy), all fitted and applied in one job.

    ``train``: dataset_id, strategy, text, label; ``test``: dataset_id, row_id, text, label. Every strategy is judged on all test
    rows of its dataset. Fitting is counting: words per class with partial aggregation. A test row's words meet the
    counts by (dataset, word), and only words of the training part add to the smoothed log-likelihood beyond a
    term that depends on the row's length. Equal scores go to the smaller label. The class counts are one row per
    dataset, strategy and class.
    """
    group = ["dataset_id", "strategy"]
    words = train.select(*group, "label", F.explode(ws_tokens(F.col("text"))).alias("token"))
    learned = settle(words.groupBy(*group, "label", "token").agg(F.count(F.lit(1)).alias("c")), "learned")
    sizes = train.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("rows"))
    prior = F.log(F.col("rows") / F.sum("rows").over(Window.partitionBy(*group)))
    totals = learned.groupBy(*group, "label").agg(F.sum("c").alias("total"))
    kinds = learned.groupBy(*group).agg(F.count_distinct("token").alias("kinds"))
    classes = sizes.withColumn("prior", prior).join(totals, [*group, "label"], "left").join(kinds, group, "left")
    unseen = F.log(F.coalesce("total", F.lit(0)) + F.coalesce("kinds", F.lit(0)) + F.lit(1.0))
    classes = settle(classes.select(*group, "label", "prior", unseen.alias("unseen")), "classes")

    tokens = ws_tokens(F.col("text"))
    rows = test.select("dataset_id", "row_id", F.col("label").alias("y_true"), F.size(tokens).alias("length"))
    seen = test.select("dataset_id", "row_id", F.explode(tokens).alias("token"))
    seen = seen.groupBy("dataset_id", "row_id", "token").agg(F.count(F.lit(1)).alias("n"))
    hits = seen.join(learned, ["dataset_id", "token"]).groupBy(*group, "row_id", "label")
    hits = hits.agg(F.sum(F.col("n") * F.log(F.col("c") + F.lit(1.0))).alias("s"))
    scored = attach_settled(rows, classes, ["dataset_id"]).join(hits, [*group, "row_id", "label"], "left")
    score = F.col("prior") + F.coalesce("s", F.lit(0.0)) - F.col("length") * F.col("unseen")
    best = F.max_by("label", F.struct(score.alias("score"), (-F.col("label")).alias("label")))
    return scored.groupBy(*group, "row_id", "y_true").agg(best.alias("y_pred"))


def run_records(
    jobs: DataFrame, strategy: str, model_name: str, epochs: int, patience: int
) -> DataFrame:
    """Finished jobs (job_id, success, skipped, elapsed_seconds, error) as rows for ``upsert_runs``."""
    return jobs.select(
        "job_id",
        F.lit(strategy).alias("strategy"),
        F.lit(model_name).alias("model_name"),
        F.lit(epochs).alias("epochs"),
        F.lit(patience).alias("patience"),
        "success",
        F.round("elapsed_seconds", 1).alias("elapsed_seconds"),
        F.lit("measured").alias("elapsed_source"),
        "error",
        "skipped",
    )
