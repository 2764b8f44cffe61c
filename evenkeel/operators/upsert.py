"""Keyed upserts and lookups over several sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace existing rows of the same key; the others stay. Both sides have one row per key."""
    keys = list(keys)
    kept = existing.join(incoming.select(*keys), keys, "left_anti")
    return kept.select(*incoming.columns).unionByName(incoming)


def upsert_distribution(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, ["dataset_id"])


def upsert_runs(existing: DataFrame, finished: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Run log: a skipped job keeps its old row, a run or failed job replaces it."""
    return upsert(existing, finished.where(~F.col("skipped")).drop("skipped"), keys).orderBy(*keys)


def upsert_metrics(existing: DataFrame, evaluated: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Metric log: only a successful evaluation replaces the old row.

    The key is the full dataset id, so datasets of one name under two authors do not collide.
    """
    return upsert(existing, evaluated.where(F.col("success")).drop("success"), keys)


def lookup_with_fallback(
    wanted: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str], strict: bool = True
) -> DataFrame:
    """For every wanted key the row of the first source that has it; ``strict`` makes a missing key an error."""
    keys = list(keys)
    values = [c for c in sources[0].columns if c not in keys]
    out = wanted.select(*keys)
    hits = []
    for i, source in enumerate(sources):
        hit = F.struct(F.lit(i).alias("source_no"), *values).alias(f"_s{i}")
        out = out.join(source.select(*keys, hit), keys, "left")
        hits.append(F.col(f"_s{i}"))
    found = F.coalesce(*hits)
    if strict:
        found = F.when(found.isNull(), F.raise_error(F.lit("key not found in any source"))).otherwise(found)
    return out.select(*keys, found.alias("_hit")).select(*keys, "_hit.*")
