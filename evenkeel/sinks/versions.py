"""Small keyed tables kept in versions: each write is a folder of its own, and a manifest names the current one.

A version is written in full before it is named. Naming is one rename that fails if the name is taken, so readers see the old or
the new version, an interrupted write is never seen, and of two writers that started from one version the second is told.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession

from evenkeel.sinks.files import file_names, read_text, rename_new, write_text

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(PySparkException):
    """Another writer has named the version first."""


def _manifest(root: str, version: int) -> str:
    return f"{root}/manifest/{version:010d}"


def current_version(spark: SparkSession, root: str) -> int:
    """The number of the current version; 0 for none."""
    return max((int(name) for name in file_names(spark, f"{root}/manifest") if name.isdigit()), default=0)


def read_version(spark: SparkSession, root: str, schema, version: int | None = None) -> DataFrame:
    """The current version, or an earlier one; empty where nothing was written."""
    version = current_version(spark, root) if version is None else version
    if not version:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{read_text(spark, _manifest(root, version))}")


def write_version(table: DataFrame, root: str, after: int) -> int:
    """Write ``table`` as the version that follows ``after``; ``Conflict`` if another writer was faster."""
    spark = table.sparkSession
    folder = f"version-{after + 1:010d}-{uuid.uuid4().hex}"
    table.write.parquet(f"{root}/{folder}")
    draft = f"{root}/drafts/{folder}"
    write_text(spark, draft, folder)
    if not rename_new(spark, draft, _manifest(root, after + 1)):
        raise Conflict(f"version {after + 1} of {root} was written by another writer")
    return after + 1


def upsert_version(incoming: DataFrame, root: str, schema, merge: Merge, attempts: int = 3) -> int:
    """Merge ``incoming`` into the current version and make the result the next one; returns its number.

    A writer that another one overtook merges again with the newer version.
    """
    spark = incoming.sparkSession
    for attempt in range(attempts):
        version = current_version(spark, root)
        merged = merge(read_version(spark, root, schema, version), incoming)
        try:
            return write_version(merged, root, version)
        except Conflict:
            if attempt == attempts - 1:
                raise
    raise ValueError("no attempts")


