"""Readers of logs and result documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.labels import paraphrase_pass, paraphrase_source

PASS_LINE = "id string, text string, label int"
LOG_SCHEMA = "dataset_id string, src_id long, text string, label int, pass int"
PUBLISHED_SCHEMA = (
    "dataset string, methods array<struct<method: string, macro_f1: double, tpr_gap: double, speedup: double, "
    "precision_majority: double, recall_majority: double, precision_minority: double, recall_minority: double>>"
)
RUN_SCHEMA = (
    "job_id string, strategy string, model_name string, epochs int, patience int, success boolean, "
    "elapsed_seconds double, elapsed_source string, error string"
)
METRIC_SCHEMA = "map<string, struct<accuracy: double, macro_f1: double, tpr_class_0: double, tpr_class_1: double, tpr_gap: double>>"


def _or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_pass_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (id, text, label) of a pass; blank lines are skipped, a missing file is empty.

    Pass number and source row are read out of the id.
    """
    lines = _or_empty(
        spark, PASS_LINE, lambda: spark.read.schema(PASS_LINE).option("mode", "FAILFAST").json(path)
    )
    return lines.select(
        "id", paraphrase_pass(F.col("id")).alias("pass"), paraphrase_source(F.col("id")).alias("src_id"), "text", "label"
    )


def read_generation_log(spark: SparkSession, path: str) -> DataFrame:
    """The table written by ``append_generated``; a missing one is empty."""
    return _or_empty(spark, LOG_SCHEMA, lambda: spark.read.schema(LOG_SCHEMA).parquet(path))


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Nested documents of published results, one JSON array per file."""
    return spark.read.schema(PUBLISHED_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run log, one JSON array per file; a missing one is empty."""
    return _or_empty(
        spark, RUN_SCHEMA, lambda: spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(path)
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics from a JSON object keyed by dataset."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", METRIC_SCHEMA)).alias("dataset_id", "m"))
    return parsed.select("dataset_id", "m.*")
