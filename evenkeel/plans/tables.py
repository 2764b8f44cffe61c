"""The given tables in the shapes the operators work on. Every shape is a rule over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.labels import dataset_key
from evenkeel.functions.text import clean_generation
from evenkeel.workspace import spread_small


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for work on their texts."""
    return spread_small(table(spark, sf, "documents"), "doc_id")


def examples(spark: SparkSession, sf: str, documents: DataFrame | None = None) -> DataFrame:
    """Labelled documents, one dataset per language."""
    documents = table(spark, sf, "documents") if documents is None else documents
    joined = documents.join(table(spark, sf, "labels"), "doc_id")
    return joined.select(
        dataset_key(F.lit("lang"), F.col("lang")).alias("dataset_id"),
        F.col("doc_id").alias("row_id"),
        "text",
        F.col("quality").alias("label"),
    )


def all_examples(spark: SparkSession, sf: str, documents: DataFrame | None = None) -> DataFrame:
    """All documents; those without a label have -1."""
    documents = table(spark, sf, "documents") if documents is None else documents
    joined = documents.join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select(
        dataset_key(F.lit("lang"), F.col("lang")).alias("dataset_id"),
        F.col("doc_id").alias("row_id"),
        "text",
        F.coalesce("quality", F.lit(-1)).alias("label"),
    )


def event_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Events as one dataset with 39 positive rows to a negative one."""
    return table(spark, sf, "events").select(
        F.lit("events/stream").alias("dataset_id"),
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("text"),
        F.when(F.col("event_id") % 40 == 0, 0).otherwise(1).alias("label"),
    )


def split_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Examples with parts of their own: by source for English, train only for German, none elsewhere."""
    source = F.col("source")
    own = F.when(source.startswith("src1"), "test").when(source == "src7", "extra").otherwise("train")
    part = F.when(F.col("lang") == "en", own).when(F.col("lang") == "de", F.lit("train"))
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return joined.select(
        dataset_key(F.lit("lang"), F.col("lang")).alias("dataset_id"),
        F.col("doc_id").alias("row_id"),
        F.col("quality").alias("label"),
        part.alias("split"),
    )


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as reviews rated 1 to 5, the first line of an order without text."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_quantity").cast("int") % 5 + 1).cast("double").alias("overall"),
        F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_returnflag")).alias("reviewText"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of two strategies, one dataset per language and source."""
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    base = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(F.col("quality"))
    over = F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    both = F.array(
        F.struct(F.lit("baseline").alias("strategy"), base.alias("y_pred")),
        F.struct(F.lit("simple_oversampling").alias("strategy"), over.alias("y_pred")),
    )
    return joined.select(
        dataset_key(F.col("lang"), F.col("source")).alias("dataset_id"),
        F.col("doc_id").alias("row_id"),
        F.col("quality").alias("y_true"),
        F.explode(both).alias("p"),
    ).select("dataset_id", "p.strategy", "row_id", "y_true", "p.y_pred")


def _dropped(words: list[str], row: int | None, no: int | None) -> list[str]:
    """The words that ``varied_word_drop`` keeps in pass ``no`` of a row. As in SQL, a negative sum has no remainder 1."""
    if no is None:  # no word's place is known
        return []
    turn = None if row is None else (row + no) % 4 if row + no >= 0 else -(-(row + no) % 4)
    if turn == 0:
        return words[-no % 5 :: 5]
    if turn == 1:
        return words[-no % 2 :: 2]
    return [w for first in range(-no % 5 - 4, len(words), 5) for w in words[max(first, 0) : first + 4]]


def _word_drop(text: pa.Array, row: pa.Array, no: pa.Array) -> pa.Array:
    out, last, words = [], None, []
    for value, i, k in zip(text.to_pylist(), row.to_pylist(), no.to_pylist()):
        if value != last:  # the passes of a row lie one after the other
            last, words = value, (value or "").split()
        out.append(None if value is None else " ".join(_dropped(words, i, k)))
    return pa.array(out, pa.string())


def varied_word_drop(samples: DataFrame) -> Column:
    """Stand-in for a model, by (row + pass) mod 4: keep a fifth, a half or four fifths of the words."""
    return F.arrow_udf(_word_drop, "string")("text", "src_id", "pass")


def originals(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as texts that paraphrases are made from."""
    return all_examples(spark, sf, texts(spark, sf)).withColumnRenamed("row_id", "src_id")


def generated(spark: SparkSession, sf: str, passes: int = 3) -> DataFrame:
    """Generation log of the first passes."""
    samples = originals(spark, sf).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    return samples.withColumn("text", clean_generation(varied_word_drop(samples)))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    samples = originals(spark, sf).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return samples.select(
        "dataset_id",
        "src_id",
        "pass",
        F.col("text").alias("original"),
        clean_generation(varied_word_drop(samples)).alias("paraphrase"),
    )


def distinct_tokens(documents: DataFrame) -> DataFrame:
    """The tokens of ``ws_tokens`` of all texts, each once; a task sends a token on once per Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens: set[str] = set()
            for i in range(0, batch.num_rows, 512):  # a batch's texts are not all held twice
                tokens.update(*(text.split() for text in batch.column("text").slice(i, 512).to_pylist() if text))
            yield pa.RecordBatch.from_arrays([pa.array(list(tokens), pa.string())], ["token"])

    return documents.select(F.lower("text").alias("text")).mapInArrow(run, "token string").distinct()


def token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A vector for every token of the documents: the embedding its hash points to."""
    embeddings = table(spark, sf, "embeddings")
    slot = F.conv(F.substring(F.md5("token"), 1, 15), 16, 10).cast("long") % embeddings.count()
    return distinct_tokens(texts(spark, sf)).withColumn("vec_id", slot).join(
        embeddings.select("vec_id", F.col("embedding").alias("vector")), "vec_id"
    )


def vector_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as one dataset: label 0 against the rest."""
    return table(spark, sf, "embeddings").select(
        F.lit("embeddings/all").alias("dataset_id"),
        F.col("vec_id").alias("row_id"),
        F.col("embedding").alias("vector"),
        F.when(F.col("label") == 0, 0).otherwise(1).alias("label"),
    )


def job_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Run log: each customer is a job, the priority of an order its strategy; the latest order counts."""
    priority = F.substring("o_orderpriority", 1, 1)
    strategy = (
        F.when(priority == "1", "baseline")
        .when(priority == "2", "simple_oversampling")
        .when(priority == "3", "llm_paraphrasing")
        .otherwise("undersampling")
    )
    value = F.struct("o_orderstatus", "o_totalprice")
    latest = (
        table(spark, sf, "orders")
        .groupBy(F.concat(F.lit("cust/"), "o_custkey").alias("job_id"), strategy.alias("strategy"))
        .agg(F.max_by(value, F.struct("o_orderdate", "o_orderkey")).alias("v"))
    )
    return latest.select(
        "job_id",
        "strategy",
        (F.col("v.o_orderstatus") != "F").alias("success"),
        F.col("v.o_totalprice").alias("elapsed_seconds"),
        F.when(F.length("job_id") % 2 == 0, "measured").otherwise("estimated").alias("elapsed_source"),
    )
