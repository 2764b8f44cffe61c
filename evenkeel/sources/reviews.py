"""Reviews as (gzipped) JSON lines, and two text files aligned by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.constants import EXTRA_LINE_BREAKS
from evenkeel.functions.labels import binarise_rating, binarise_score, is_opinion
from evenkeel.operators.joining import attach
from evenkeel.workspace import settle, shuffle_partitions


def read_reviews_json(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """``overall`` and ``reviewText`` of every line; a malformed line is an error, a missing text is ''.

    A gzip file is read by one task; its rows are spread afterwards, over ``partitions`` or else the session's shuffle partitions.
    """
    reader = spark.read.schema("overall double, reviewText string").option("mode", "FAILFAST")
    rows = reader.json(path).fillna({"reviewText": ""})
    zipped = any(name.endswith(".gz") for name in rows.inputFiles())
    return rows.repartition(partitions or shuffle_partitions(spark)) if partitions or zipped else rows


def labelled_reviews(reviews: DataFrame) -> DataFrame:
    """Text and label of the reviews that state an opinion."""
    kept = reviews.where(is_opinion(F.col("overall"), F.col("reviewText")))
    return kept.select(F.col("reviewText").alias("text"), binarise_rating(F.col("overall")).alias("label"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, or of a folder of files in the order of their names, with their 0-based number.

    Files are read in blocks; within a block the rows come in order, so a line's number is its place in its
    block plus the lines of the blocks before. Only one row per block is sorted. Besides line feeds, the
    Unicode line breaks end a line, too.
    """
    raw = spark.read.text(path).select(
        F.explode(F.split("value", EXTRA_LINE_BREAKS)).alias("value"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    # Written down, because the generated ids depend on how this one read was cut into tasks.
    lines = settle(raw.withColumn("_id", F.monotonically_increasing_id()), "lines")
    blocks = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_from"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from")
    placed = attach(lines, blocks.select("_file", "_block", shift.alias("_shift")), ["_file", "_block"])
    return placed.select((F.col("_id") + F.col("_shift")).alias("row_id"), "value")


def read_parallel_text(spark: SparkSession, texts: str, scores: str) -> DataFrame:
    """Text and label from two files aligned by line number; files of unequal length are an error."""
    left, right = read_lines(spark, texts), read_lines(spark, scores)
    n_left, n_right = left.count(), right.count()
    if n_left != n_right:
        raise ValueError(f"{n_left} texts but {n_right} scores")
    label = binarise_score(F.trim(F.col("value")).cast("int"))
    return left.withColumnRenamed("value", "text").join(right.select("row_id", label.alias("label")), "row_id")
