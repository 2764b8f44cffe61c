"""One strategy from labelled examples to stored features."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.constants import SEED
from evenkeel.functions.labels import hash_order
from evenkeel.operators.balance import duplicate_minority, undersample_random
from evenkeel.operators.encoding import encode_fixed, learn_vocabulary
from evenkeel.operators.hooks import Generator
from evenkeel.operators.joining import attach_settled
from evenkeel.operators.splits import train_test_split
from evenkeel.plans.paraphrase import paraphrase_balance
from evenkeel.sinks.tables import DATASET_KEYS, replace_keys
from evenkeel.workspace import settle

#: Marks of finished datasets, in a folder that readers of the root pass over.
MARK_SCHEMA = "strategy string, dataset_id string, label int, n_before long, n_after long"


def balanced(train: DataFrame, strategy: str, generate: Generator | None = None, score=None, log_path: str | None = None) -> DataFrame:
    """The training part under a strategy; ``copy`` and ``pass`` tell rows with the same id apart."""
    if strategy == "baseline":
        return train.withColumn("version", F.lit(0))
    if strategy == "simple_oversampling":
        return duplicate_minority(train).withColumnRenamed("copy", "version")
    if strategy == "undersampling":
        return undersample_random(train).withColumn("version", F.lit(0))
    if strategy == "llm_paraphrasing":
        rows = paraphrase_balance(train, generate, score, log_path)
        return rows.withColumn("version", F.coalesce(F.col("pass") + 1, F.lit(0))).drop("pass")
    raise ValueError(f"unknown strategy {strategy}")


def finished(spark: SparkSession, root: str) -> DataFrame:
    """(strategy, dataset_id, label, n_before, n_after) of all datasets that were stored to the end.

    A mark is written after its dataset's files, so a dataset without one is to be done again, whatever lies in its folders.
    """
    try:
        return spark.read.schema(MARK_SCHEMA).parquet(f"{root}/_finished")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MARK_SCHEMA)


def prepare(examples: DataFrame, strategy: str, root: str, generate: Generator | None = None, score=None, log_path: str | None = None) -> DataFrame:
    """Split, balance, order, encode and store the datasets that are not finished; returns class counts before and after of all.

    ``examples``: dataset_id, row_id, text, label. What is finished is looked up before any work is planned: with all datasets
    finished nothing is split or generated, and the counts come from the marks. The vocabulary is learned from the balanced training
    part of the datasets that come first and kept. Rows of a key are stored in the seeded order of ``place``, a hash of id and version, which the files keep. Test rows stay as they are.
    """
    spark, columns = examples.sparkSession, ["dataset_id", "row_id", "text", "label"]
    marks = finished(spark, root).where(F.col("strategy") == strategy)
    asked = examples.select("dataset_id").distinct()
    todo = settle(asked.join(marks.select("dataset_id").distinct(), "dataset_id", "left_anti"), "unfinished")
    if todo.count():
        open_rows = attach_settled(examples.select(*columns), todo, ["dataset_id"])
        _store(open_rows, strategy, root, generate, score, log_path).write.mode("append").parquet(f"{root}/_finished")
    return finished(spark, root).where(F.col("strategy") == strategy).join(asked, "dataset_id", "left_semi").select("strategy", "dataset_id", "label", "n_before", "n_after")


def _vocabulary(rows: DataFrame, path: str) -> DataFrame:
    """The strategy's vocabulary: learned from the first datasets that are stored, and the same for all that follow."""
    spark = rows.sparkSession
    try:
        return spark.read.schema("token string, token_id int").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    learn_vocabulary(rows).select("token", "token_id").write.mode("overwrite").parquet(path)
    return spark.read.schema("token string, token_id int").parquet(path)


def _store(examples: DataFrame, strategy: str, root: str, generate, score, log_path) -> DataFrame:
    """Store the examples' datasets; the marks to be written once they are there."""
    columns = examples.columns
    parts = settle(train_test_split(examples), "parts")
    train = parts.where("split = 'train'").select(*columns)
    test = parts.where("split = 'test'").select(*columns, F.lit(0).cast("long").alias("version"))
    after = settle(balanced(train, strategy, generate, score, log_path).select(*columns, F.col("version").cast("long").alias("version")), "balanced")
    vocabulary = _vocabulary(after, f"{root}/_vocabulary/{strategy}")
    both = after.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    encoded = encode_fixed(both, vocabulary=vocabulary).withColumn("strategy", F.lit(strategy))
    replace_keys(encoded.withColumn("place", hash_order(SEED, F.col("row_id"), F.col("version"))), root, order="place")
    counts = [
        rows.groupBy("dataset_id", "label").agg(F.count(F.lit(1)).alias(name)) for rows, name in ((train, "n_before"), (after, "n_after"))
    ]
    joined = counts[0].join(counts[1], ["dataset_id", "label"], "left")
    label, n_after = F.col("label").cast("int").alias("label"), F.coalesce("n_after", F.lit(0)).cast("long").alias("n_after")
    return joined.select(F.lit(strategy).alias("strategy"), "dataset_id", label, "n_before", n_after)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """Rows stored per strategy, dataset and part."""
    rows = spark.read.parquet(root)
    return rows.groupBy(*DATASET_KEYS).agg(F.count(F.lit(1)).alias("n"))
