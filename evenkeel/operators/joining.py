"""Joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.workspace import BROADCAST_ROWS, fits_broadcast, settle

# A key is hot when it holds more than one row in HOT_PARTS, so at most HOT_PARTS keys can be hot.
HOT_PARTS = 1000


def hot_keys(rows: DataFrame, on: Sequence[str], parts: int = HOT_PARTS) -> DataFrame:
    """The keys that hold more than 1/parts of the rows: fewer than ``parts`` of them."""
    counts = settle(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return counts.where(F.col("_n") * parts > total).select(*on)


def attach_settled(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    fits: bool | None = None,
) -> DataFrame:
    """Join rows to a settled lookup (one row per key) without shuffling the rows of hot keys.

    A lookup of proven small size is broadcast; ``fits`` hands over a measurement made before. Beyond the bound,
    its hot keys (bounded in number) are broadcast and only the other rows are shuffled, whose keys are then all
    small.
    """
    on = list(on)
    if fits if fits is not None else fits_broadcast(lookup, max_rows):
        return rows.join(F.broadcast(lookup), on, how)
    hot = F.broadcast(settle(hot_keys(rows, on), "hot-keys"))
    marked = rows.join(hot.withColumn("_hot", F.lit(True)), on, "left")
    hot_lookup = lookup.join(hot, on, "left_semi")
    hot_rows = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot_lookup), on, how)
    empty = reduce(Column.__or__, [F.col(c).isNull() for c in on])
    cold_rows = marked.where(F.col("_hot").isNull() & ~empty).drop("_hot").join(lookup, on, how)
    joined = hot_rows.unionByName(cold_rows)
    if how != "left":
        return joined
    # A null key has no partner; such rows are kept out of the shuffle, where they would all meet.
    return joined.unionByName(marked.where(empty).drop("_hot"), allowMissingColumns=True)


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``attach_settled`` for a lookup that is still to be computed; it is computed once."""
    return attach_settled(rows, settle(lookup, "lookup"), on, how, max_rows)


def pair_by_id(
    paraphrases: DataFrame, originals: DataFrame, keys: Sequence[str] = ("dataset_id", "src_id")
) -> DataFrame:
    """Paraphrase with its original's text as ``original``. Both sides have well spread keys."""
    keys = list(keys)
    texts = originals.select(*keys, F.col("text").alias("original"))
    return paraphrases.withColumnRenamed("text", "paraphrase").join(texts, keys, "inner")


def orphans(
    paraphrases: DataFrame, originals: DataFrame, keys: Sequence[str] = ("dataset_id", "src_id")
) -> DataFrame:
    """Paraphrases whose original is unknown: an error in the source data, to be checked for emptiness."""
    return paraphrases.join(originals.select(*keys), list(keys), "left_anti")


def pending(samples: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples that have no entry in the log yet."""
    return samples.join(log.select(*keys), list(keys), "left_anti")


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Full outer comparison; the value columns are prefixed with the side's name."""
    keys = list(keys)

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{name}__{c}") for c in df.columns if c not in keys])

    return named(left, names[0]).join(named(right, names[1]), keys, "full_outer")


def key_membership(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All keys with flags that tell which side has them; each side is read once."""
    keys = list(keys)
    both = left.select(*keys).distinct().withColumn("in_left", F.lit(True)).join(
        right.select(*keys).distinct().withColumn("in_right", F.lit(True)), keys, "full_outer"
    )
    return both.select(
        *keys,
        F.coalesce("in_left", F.lit(False)).alias("in_left"),
        F.coalesce("in_right", F.lit(False)).alias("in_right"),
    )


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with flags that tell which."""
    return key_membership(left, right, keys).where(~(F.col("in_left") & F.col("in_right")))


def key_sets(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intersection, union and both differences of two key sets, named by ``kind``, from one join."""
    in_left, in_right = F.col("in_left"), F.col("in_right")
    kinds = F.array(
        F.lit("either"),
        F.when(in_left & in_right, "both").when(in_left, "left only").otherwise("right only"),
    )
    return key_membership(left, right, keys).select(F.explode(kinds).alias("kind"), *keys)


def keep_complete(comparison: DataFrame, complete: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is complete; when no key at all is complete, every row."""
    keys = list(keys)
    if complete.isEmpty():
        return comparison
    return comparison.join(complete.select(*keys), keys, "left_semi")
