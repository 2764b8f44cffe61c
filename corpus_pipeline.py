"""Corpus pipeline: stages applied to ``documents`` one after the other, each written and read again.

Every stage but the last returns the columns of ``documents``; what a stage drops is gone for those after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import decontaminate, mixing, near_duplicates, packing, quality
from evenkeel.llm.common import held_out
from evenkeel.workspace import settle

#: Documents whose probability of label 1 is below this are rejected.
QUALITY = 0.7


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from labelled rows that are not held out."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=~held_out("key"))
    scored = quality.score(docs, model, name="_score", keep_text=True)
    return scored.where(F.col("_score") >= QUALITY).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return near_duplicates.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids."""
    return packing.pack(docs)


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("decontaminate", remove_benchmark), ("mix", mix), ("pack", pack)]

#: The stages that learn, search and pack are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
