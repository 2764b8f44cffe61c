"""Resumable generation as a stream of files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evenkeel.operators.hooks import Generator
from evenkeel.sources.results import read_generation_log

KEYS = ["dataset_id", "src_id"]
SAMPLE_COLUMNS = ["dataset_id", "src_id", "text", "label"]
SAMPLE_SCHEMA = "dataset_id string, src_id long, text string, label int"
#: Groups of keys that share one state. A call of Python costs milliseconds, so it serves many keys; the number stays with a checkpoint.
BUCKETS = 4096


def first_of_keys(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """For each ``key`` of a bucket its first sample, if the key is neither logged nor among the keys that the state has seen."""
    seen = set(json.loads(state.get[0])) if state.exists else set()
    first, logged = None, set()
    for part in parts:  # of a key with very many samples one row is kept
        logged.update(part["key"][part["logged"]])
        own = part[~part["logged"] & ~part["key"].isin(seen)]
        if len(own):
            own = own if first is None else pd.concat([first, own])
            first = own.sort_values(["text", "label"]).drop_duplicates("key")
    known = seen | logged | (set() if first is None else set(first["key"]))
    if len(known) > len(seen):
        state.update((json.dumps(sorted(known)),))
    if first is not None:
        yield first.loc[~first["key"].isin(logged), SAMPLE_COLUMNS]


def _logged_before(spark: SparkSession, log_path: str, checkpoint: str, pass_no: int) -> str:
    """A folder with the keys that were logged when this checkpoint was new. It is written once and read by the first batch."""
    seed = f"{checkpoint.rstrip('/')}/logged-before"
    try:
        spark.read.parquet(seed)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        keys = read_generation_log(spark, log_path).where(F.col("pass") == pass_no).select(*KEYS).distinct()
        keys.write.mode("overwrite").parquet(seed)
    return seed


def write_batch(generated: DataFrame, log_path: str, pass_no: int, name: str) -> None:
    """One folder per batch: a batch that is run again replaces what it had written."""
    generated.select(*KEYS, "text", "label").write.mode("overwrite").parquet(f"{log_path}/pass={pass_no}/{name}")


def generate_stream(
    spark: SparkSession,
    source: str,
    generate: Generator,
    log_path: str,
    checkpoint: str,
    pass_no: int = 0,
    files_per_batch: int = 1,
):
    """Log a paraphrase of every sample under ``source`` (Parquet) and stop when all files are read.

    Files are taken in small batches, and each batch is logged in a folder of its own before the next begins. The keys that were seen are
    the stream's state, kept with the checkpoint, so a batch reads its own samples and no log. After an interruption the stream
    goes on with the first unfinished batch and replaces its folder. Under a new checkpoint the keys that the log has are read
    once, as the first batch's input, into the state. Of several samples with one key one is generated.
    """
    seed = _logged_before(spark, log_path, checkpoint, pass_no)
    samples = spark.readStream.schema(SAMPLE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    logged = spark.readStream.schema("dataset_id string, src_id long").parquet(seed)
    nothing = [F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("label"), F.lit(True).alias("logged")]
    both = samples.withColumn("logged", F.lit(False)).unionByName(logged.select(*KEYS, *nothing))
    # The id travels as text: beside a missing one pandas would make numbers with a fraction of it.
    named = both.withColumns({"key": F.to_json(F.struct(*KEYS)), "bucket": F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)), "src_id": F.col("src_id").cast("string")})
    schema = SAMPLE_SCHEMA.replace("src_id long", "src_id string")
    fresh = named.groupBy("bucket").applyInPandasWithState(first_of_keys, schema, "keys string", "append", GroupStateTimeout.NoTimeout)
    fresh = fresh.withColumn("src_id", F.col("src_id").cast("long"))

    def log_batch(batch: DataFrame, batch_id: int) -> None:
        # The id of a query stays with its checkpoint, so another checkpoint's batches have other folders.
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write_batch(generate(batch.withColumn("pass", F.lit(pass_no))), log_path, pass_no, f"stream-{query_id}-{batch_id:06d}")

    query = (
        fresh.writeStream.foreachBatch(log_batch)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
