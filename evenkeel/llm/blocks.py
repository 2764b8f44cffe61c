"""Comparing all nodes of a bucket inside tasks, whatever the bucket's size.

A node has an identity ``f`` (16 bytes), a size ``n``, a component ``c`` (16 bytes), its bucket ``keys`` (array) and a bitmap in the columns
``s0``, ``s1``, ..; alike nodes have bitmaps that differ in few bits. A row is a node in one of its buckets (``key``) with the number
``m`` of that bucket's nodes. Pairs stay inside tasks; what leaves them grows with the nodes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.workspace import shuffle_partitions

BLOCK = 512


def sign_columns(names: Iterable[str]) -> list[str]:
    return sorted((c for c in names if re.fullmatch(r"s\d+", c)), key=lambda c: int(c[1:]))


def meet_in_blocks(rows: DataFrame, blocks: Column, *columns: str) -> DataFrame:
    """Deal the rows of every ``key`` out so that any two of them meet in some group (key, i, j), sorted by group.

    A key's rows are cut into ``blocks`` blocks by the hash of f; every two blocks, and each with itself, are a group.
    """
    placed = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = met.select("key", "i", "j", "own", *columns).repartition(shuffle_partitions(rows.sparkSession), "key", "i", "j")
    return dealt.sortWithinPartitions("key", "i", "j", "own")


def groups_of(batches):
    """The groups (key, i, j) of sorted batches as tables."""
    group, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(x).to_numpy() for x in ("key", "i", "j")], axis=1)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if group and tuple(names[start]) != name:
                yield pa.Table.from_batches(group)
                group = []
            name = tuple(names[start])
            group.append(batch.slice(start, end - start))
    if group:
        yield pa.Table.from_batches(group)


class Group:
    """The nodes of one group, and which of them are still to be compared."""

    def __init__(self, table: pa.Table, most: int, ratio: float):
        signs = sign_columns(table.column_names)
        self.f, self.n, self.most, self.ratio = table["f"].to_pylist(), table["n"].to_numpy(), most, ratio
        self.component = np.unique(np.array(table["c"].to_pylist(), "S16"), return_inverse=True)[1]
        own, i, j = table["own"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        self.within, self.left, self.right = i == j, np.flatnonzero(own == i), np.flatnonzero(own == j)
        self.sketch = np.stack([table[s].to_numpy() for s in signs], axis=1).view(np.uint64)
        self.keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(self.f), -1)
        self.band = int(np.flatnonzero(self.keys[0] == table["key"][0].as_py())[0])

    def likely(self, k: int) -> np.ndarray:
        """Partners of the k-th node on the left: of another component, alike by sketch, first bucket in common."""
        x, against = self.left[k], self.right[k + 1 :] if self.within else self.right
        least, largest = np.minimum(self.n[against], self.n[x]), np.maximum(self.n[against], self.n[x])
        against = against[(self.component[against] != self.component[x]) & (least >= self.ratio * largest)]
        against = against[np.bitwise_count(self.sketch[against] ^ self.sketch[x]).sum(axis=1) <= self.most]
        return against[(self.keys[against] == self.keys[x]).argmax(axis=1) == self.band]


def likely_nodes(rows: DataFrame, most: int, ratio: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(key, f) of the nodes with a likely partner of another component in that bucket, by sketch."""
    signs = sign_columns(rows.columns)

    def run(batches):
        for table in groups_of(batches):
            group = Group(table, most, ratio)
            flagged = np.zeros(len(group.f), bool)
            for k in range(len(group.left)):
                partners = group.likely(k)
                flagged[partners] = True
                flagged[group.left[k]] |= len(partners) > 0
            at = np.flatnonzero(flagged)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([table["key"][0].as_py()] * len(at), pa.int64()), table["f"].take(at).combine_chunks()], ["key", "f"])

    met = meet_in_blocks(rows, F.ceil(F.col("m") / block), "f", "n", "c", "keys", *signs)
    return met.mapInArrow(run, "key long, f binary").distinct()
