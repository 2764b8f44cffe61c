"""Nested documents to rows, maps to rows, long to wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.labels import dataset_key, key_author, key_name
from evenkeel.operators.joining import attach
from evenkeel.operators.ranking import first_match


def flatten_methods(published: DataFrame) -> DataFrame:
    """One row per method of every published result document."""
    return published.select("dataset", F.explode("methods").alias("m")).select("dataset", "m.*")


def select_methods(methods: DataFrame, names: Sequence[str]) -> DataFrame:
    return methods.where(F.col("method").isin(list(names)))


def published_baseline(published: DataFrame, method: str = "baseline") -> DataFrame:
    """Each document's first entry for the method; a document without one is an error."""
    entries = published.select("dataset", F.posexplode("methods").alias("pos", "m"))
    value = F.struct("m.macro_f1", "m.tpr_gap", "m.speedup")
    return first_match(entries, ["dataset"], "pos", F.col("m.method") == method, value).select(
        "dataset", "found.*"
    )


def metrics_long(metrics: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per metric."""
    return metrics.unpivot(list(ids), list(values), "metric", "value")


def metrics_from_map(results: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Rows (dataset, metric, value) from a column of type map<dataset, map<metric, value>>."""
    per_dataset = results.select(F.explode(metrics).alias("dataset", "_m"))
    return per_dataset.select("dataset", F.explode("_m").alias("metric", "value"))


def strategy_table(metrics: DataFrame, strategies: Sequence[str], values: Sequence[str], digits: int = 4) -> DataFrame:
    """Wide table with one column per strategy and metric, for the given strategies."""
    return (
        metrics.groupBy("dataset_id")
        .pivot("strategy", list(strategies))
        .agg(*[F.round(F.first(v), digits).alias(f"_{v}") for v in values])
        .select(
            "dataset_id",
            *[F.col(f"{s}__{v}") for s in strategies for v in values],
        )
    )


def resolve_author(df: DataFrame, config: DataFrame, key: str = "key") -> DataFrame:
    """Add ``author`` and ``name``: 'author/name' is parsed, a bare name is looked up (author, name)."""
    named = df.withColumn("name", key_name(F.col(key))).withColumn("_given", key_author(F.col(key)))
    known = config.groupBy("name").agg(F.max("author").alias("_known"))
    out = attach(named, known, ["name"], "left")
    return out.select(*df.columns, F.coalesce("_given", "_known").alias("author"), "name")


def resolve_names(df: DataFrame, config: DataFrame, key: str = "key") -> DataFrame:
    """``resolve_author`` that tells how a key was resolved.

    ``resolution`` is ``given`` for 'author/name', ``known`` for a bare name of one author, ``ambiguous`` for a name of several and
    ``unknown`` for any other; the last two have no author.
    """
    authors = config.groupBy("name").agg(F.max("author").alias("_known"), F.count_distinct("author").alias("_authors"))
    named = df.withColumn("name", key_name(F.col(key))).withColumn("_given", key_author(F.col(key)))
    out = attach(named, authors, ["name"], "left")
    resolution = (
        F.when(F.col("_given").isNotNull(), "given")
        .when(F.col("_authors") == 1, "known")
        .when(F.col("_authors") > 1, "ambiguous")
        .otherwise("unknown")
    )
    author = F.when(resolution == "known", F.col("_known")).otherwise(F.col("_given"))
    return out.select(*df.columns, author.alias("author"), "name", resolution.alias("resolution"))


def named_metrics_with_ratio(metrics: DataFrame, config: DataFrame, distribution: DataFrame, key: str = "key") -> DataFrame:
    """Metrics under full or bare names with their dataset's imbalance ratio, lowest Macro-F1 first.

    The ratio is null where the name could not be resolved or its dataset has none.
    """
    resolved = resolve_names(metrics, config, key).withColumn("dataset_id", dataset_key(F.col("author"), F.col("name")))
    return metrics_with_ratio(resolved, distribution)


def select_datasets(df: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """Rows of the given datasets; no list or an empty one means all."""
    return df.where(F.col("dataset_id").isin(list(ids))) if ids else df


def metrics_with_ratio(metrics: DataFrame, distribution: DataFrame) -> DataFrame:
    """Metrics with their dataset's imbalance ratio (null where unknown), lowest Macro-F1 first."""
    ratios = distribution.select("dataset_id", "imbalance_ratio")
    return attach(metrics, ratios, ["dataset_id"], "left").orderBy("macro_f1")
