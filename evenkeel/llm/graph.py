"""Connected components of a table of links, in a few shuffles over narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.workspace import settle


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Every neighbour of u that ``keep`` admits, linked to the smallest neighbour of u or u itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m")).where(keep)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that occurs in a link; the component is its smallest node.

    Large-star and small-star rounds alternate until nothing changes: the number of rounds grows with the logarithm of
    the longest path. Every round is written to the shared folder, so plans stay short and lost executors cost a
    round at most. A node with very many links is one key of a join whose partitions Spark may split; its
    smallest neighbour is found with partial aggregation. Links of a node with itself and repeated links are harmless;
    links with a null end are ignored.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = settle(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while (now := _signature(edges)) != before and now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(large, "large-star")
        small = _star(large, F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = large.groupBy("u").agg(F.min("v").alias("v"))
        edges = settle(small.unionByName(own).distinct(), "small-star")
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return settle(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
