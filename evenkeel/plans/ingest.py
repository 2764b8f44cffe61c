"""From review files to a profiled dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators.profile import distribution_entry
from evenkeel.operators.upsert import upsert_distribution
from evenkeel.sinks.tables import write_dataset
from evenkeel.sources.reviews import labelled_reviews, read_reviews_json


def ingest_reviews(spark: SparkSession, source: str, target: str, partitions: int | None = None) -> DataFrame:
    """Write the labelled reviews as Parquet and read them back."""
    write_dataset(labelled_reviews(read_reviews_json(spark, source, partitions)), target)
    return spark.read.parquet(target)


def profile_into(df: DataFrame, dataset_id: str, known: DataFrame | None = None) -> DataFrame:
    """The catalogue of class distributions with this dataset's entry added or replaced."""
    entry = distribution_entry(df.withColumn("dataset_id", F.lit(dataset_id)))
    return entry if known is None else upsert_distribution(known, entry)
