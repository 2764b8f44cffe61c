"""Token counts from flat token files that have no index.

A token file is nothing but little-endian identifiers one after the other, each document ended by one reserved
identifier. Files are cut into blocks of bytes that any task can read. A block reports the tokens before each of its
separators (one vectorised search) and those behind the last; a prefix scan over the short block reports of a file
then tells what each block carries over from the blocks before it, which completes the documents cut by a boundary.

``write_token_files`` makes such files from documents, one per task, in the shared folder that the session names. The
tasks report which document stands where; a task that is run again writes another file, and only reported files are
read. Nulls and empty texts are documents of 0 tokens; repeated rows are documents of their own; an empty table gives
no files and no rows. Tokens behind a file's last separator are a document with ``ended`` false.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import list_rows, text_slices, vocabulary_path
from evenkeel.llm.tokens import END, VOCABULARY, Encoder, dtype_for
from evenkeel.workspace import new_path, settle, shuffle_partitions

BLOCK_BYTES = 16 << 20


def file_system(path: str):
    """File system and path within it of a path as Spark writes it."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Write the documents' ids to flat files; returns (path, n_bytes, ordinal, doc_id), one row per document."""
    folder, path, dtype = new_path(docs.sparkSession, "token-files"), vocabulary or vocabulary_path(VOCABULARY), dtype_for(end)

    def run(batches: Iterator[pa.RecordBatch]):
        encoder, name, ids, size = Encoder(path), f"{folder}/{uuid.uuid4().hex}.bin", [], 0
        first = next(batches, None)
        if first is None:
            return
        store, place = file_system(name)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        with store.open_output_stream(place) as out:
            batch = first
            while batch is not None:
                for part, texts in text_slices(batch, "text"):
                    ids += part.column("doc_id").to_pylist()
                    data = np.concatenate([np.append(encoder.ids(t), end) for t in texts]).astype(dtype)
                    out.write(data.tobytes())
                    size += data.nbytes
                batch = next(batches, None)
        for i in range(0, len(ids), 1 << 16):
            own = ids[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(own)), pa.array([size] * len(own), pa.int64()), pa.array(range(i, i + len(own)), pa.int64()), pa.array(own, pa.int64())],
                ["path", "n_bytes", "ordinal", "doc_id"],
            )

    chosen = docs.selectExpr(f"CAST(`{doc_id}` AS LONG) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    return settle(chosen.mapInArrow(run, "path string, n_bytes long, ordinal long, doc_id long"), "token-index")


def list_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n_bytes) of the files in a folder, without reading them."""
    return spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("n_bytes"))


def count_tokens(files: DataFrame, end: int = END, width: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, n_tokens, ended) of every document in the files (path, n_bytes); the separator is not counted."""
    dtype = np.dtype(f"<u{width}") if width else dtype_for(end)
    block_bytes -= block_bytes % dtype.itemsize
    spark = files.sparkSession

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path, block, size in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "size")), strict=True):
                store, place = file_system(path)
                with store.open_input_file(place) as source:
                    source.seek(block * block_bytes)
                    ids = np.frombuffer(source.read_buffer(size), dtype)
                at = np.flatnonzero(ids == end)
                before = np.diff(at, prepend=-1) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block], pa.int64()), list_rows(pa.array(before, pa.int64()), np.array([len(at)])), pa.array([len(ids) - 1 - (at[-1] if len(at) else -1)], pa.int64())],
                    ["path", "block", "before", "behind"],
                )

    blocks = files.where(F.col("n_bytes") >= dtype.itemsize).select(
        "path",
        F.explode(F.sequence(F.lit(0), F.expr(f"(n_bytes - 1) div {block_bytes}"))).alias("block"),
        F.expr(f"n_bytes - n_bytes % {dtype.itemsize}").alias("n_bytes"),
    )
    sized = blocks.withColumn("size", F.least(F.lit(block_bytes), F.col("n_bytes") - F.col("block") * block_bytes)).where("size > 0")
    spread = sized.repartition(shuffle_partitions(spark), "path", "block")
    reports = settle(spread.mapInArrow(scan, "path string, block long, before array<long>, behind long"), "blocks")

    # The scan: documents ended so far, and tokens since the last separator of any earlier block.
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    short = reports.select("path", "block", F.size("before").cast("long").alias("ends"), "behind")
    sums = short.withColumn("sum", F.coalesce(F.sum("behind").over(earlier), F.lit(0)))
    since = F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("sum"))).over(earlier), F.lit(0))
    last = F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull()
    carried = sums.select(
        "path",
        "block",
        "ends",
        "behind",
        (F.col("sum") - since).alias("carry"),
        F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("first"),
        last.alias("last"),
    )
    carried = settle(carried, "carries")
    ended = (
        reports.where(F.size("before") > 0)
        .join(carried.select("path", "block", "carry", "first"), ["path", "block"])
        .select("path", "first", "carry", F.posexplode("before").alias("at", "n"))
        .select(
            "path",
            (F.col("first") + F.col("at")).alias("ordinal"),
            (F.col("n") + F.when(F.col("at") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"),
            F.lit(True).alias("ended"),
        )
    )
    open_tokens = F.col("behind") + F.when(F.col("ends") == 0, F.col("carry")).otherwise(0)
    open_end = carried.where("last").select("path", (F.col("first") + F.col("ends")).alias("ordinal"), open_tokens.alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(open_end.where("n_tokens > 0"))
