"""Near-duplicate vectors: random hyperplanes, exact cosine, connected components.

The signs of a vector's products with random directions are cut into the keys of several tables; vectors of one label that
share a key in any table meet in a task. There their sign bitmaps are compared, and where few signs differ the exact cosine is taken in
double precision, each pair in the first table that its vectors share. A task reports per vector how many vectors it is linked with and
the smallest of its local component, never the pairs, so groups of thousands of alike vectors cost no more rows than others.
Vectors that are equal in every component are one node with a count.

Keys have as many bits as make buckets of unrelated vectors small for the number of rows; the number of tables follows
from it so that a pair at the threshold is missed with a probability of at most ``miss`` at every size. A pair is also
missed if its signs differ by five standard deviations more than expected at the threshold (3e-7).

Vectors that are null, empty or zero, or hold null or non-finite components, and rows without a label, have no links and are their
own component. Vectors of different lengths are never linked. Repeated rows count as further vectors. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.blocks import BLOCK, Group, groups_of, likely_nodes, meet_in_blocks, sign_columns
from evenkeel.llm.common import list_rows
from evenkeel.llm.graph import components
from evenkeel.workspace import settle

THRESHOLD = 0.98
MISS = 1e-6
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def same_sign(cosine: float) -> float:
    """Probability that a random direction gives both vectors the same sign."""
    return 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi


def key_bits(rows: int) -> int:
    return max(6, min(30, math.ceil(math.log2(max(1, rows) / 32))))


def table_count(threshold: float, bits: int, miss: float) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-(same_sign(threshold) ** bits))))


def most_bits(threshold: float, total: int) -> int:
    p = 1 - same_sign(threshold)
    return math.ceil(total * p + 5 * math.sqrt(total * p * (1 - p)))


class Planes:
    """Random directions, the same in every task; made for the vector length that is asked for."""

    def __init__(self, tables: int, bits: int, seed: int = 1):
        self.tables, self.bits, self.seed, self.made = tables, bits, seed, {}

    def signs(self, vectors: np.ndarray) -> np.ndarray:
        dim = vectors.shape[1]
        if dim not in self.made:
            self.made[dim] = np.random.default_rng([self.seed, dim]).standard_normal((dim, self.tables * self.bits))
        return vectors @ self.made[dim] > 0

    def keys(self, signs: np.ndarray, label: np.ndarray, dim: int) -> np.ndarray:
        value = signs.reshape(len(signs), self.tables, self.bits) @ (np.uint64(1) << np.arange(self.bits, dtype=np.uint64))
        h = np.arange(self.tables, dtype=np.uint64) * FACTOR + np.uint64(dim)
        for part in (label[:, None], value):
            h = (h ^ part) * MIX
            h = (h ^ (h >> np.uint64(31))) * FACTOR
        return h.view(np.int64)


def bitmaps(signs: np.ndarray) -> np.ndarray:
    width = -(-signs.shape[1] // 64) * 64
    padded = np.zeros((len(signs), width), np.uint8)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded, axis=1).view(np.int64)


def unit(vector: np.ndarray) -> np.ndarray:
    scaled = vector / np.abs(vector).max()
    return scaled / np.sqrt(scaled @ scaled)


def vectors_of(column: pa.Array) -> list[np.ndarray | None]:
    """Double-precision vectors; None for those that have no cosine."""
    offsets, values = column.offsets.to_numpy(), column.values
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])  # a null component is NaN here
    out = []
    for i, valid in enumerate(column.is_valid().to_pylist()):
        a, b = offsets[i], offsets[i + 1]
        usable = valid and b > a and bad[b] == bad[a] and flat[a:b].any()
        out.append(flat[a:b] if usable else None)
    return out


def nodes_of(rows: DataFrame, planes: Planes, words: int) -> DataFrame:
    """(vec_id, f, keys, s0.., v): identity, table keys, sign bitmap and unit vector; null where there is no cosine."""
    signs = [f"s{i}" for i in range(words)]

    def run(batches):
        for batch in batches:
            labels, vectors = batch.column("label").to_pylist(), vectors_of(batch.column("embedding"))
            usable = [i for i, v in enumerate(vectors) if v is not None and labels[i] is not None]
            f, keys = [None] * len(vectors), np.zeros((len(vectors), planes.tables), np.int64)
            maps, units = np.zeros((len(vectors), words), np.int64), [None] * len(vectors)
            by_length: dict[int, list[int]] = {}
            for i in usable:
                by_length.setdefault(len(vectors[i]), []).append(i)
                f[i] = hashlib.blake2b(vectors[i].tobytes() + repr(labels[i]).encode(), digest_size=16).digest()
                units[i] = unit(vectors[i])
            for dim, own in by_length.items():
                label = np.array([int.from_bytes(hashlib.blake2b(repr(labels[i]).encode(), digest_size=8).digest(), "little") for i in own], np.uint64)
                sign = planes.signs(np.stack([units[i] for i in own]))
                keys[own], maps[own] = planes.keys(sign, label, dim), bitmaps(sign)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array(f, pa.binary()),
                    list_rows(pa.array(keys.ravel()), np.full(len(vectors), planes.tables)),
                    *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(words)),
                    pa.array([None if u is None else u.tobytes() for u in units], pa.binary()),
                ],
                ["vec_id", "f", "keys", *signs, "v"],
            )

    return rows.mapInArrow(run, "vec_id long, f binary, keys array<long>, " + ", ".join(f"{s} long" for s in signs) + ", v binary")


def links_in_blocks(rows: DataFrame, most: int, threshold: float, block: int) -> DataFrame:
    """(f, links, least): per node and group, how many vectors it is linked with there and the smallest node of its local component."""

    def run(batches):
        for table in groups_of(batches):
            group = Group(table, most, 0.0)
            unit_, count, size = [np.frombuffer(v) for v in table["v"].to_pylist()], table["count"].to_numpy(), len(table)
            links, root = np.zeros(size, np.int64), np.arange(size)
            for k in range(len(group.left)):
                x, partners = group.left[k], group.likely(k)
                if len(partners):
                    near = partners[np.stack([unit_[y] for y in partners]) @ unit_[x] >= threshold]
                    links[x] += count[near].sum()
                    links[near] += count[x]
                    for other in np.unique(root[near]):
                        root[root == other] = root[x]
            at = np.flatnonzero(links)
            if len(at):
                least: dict[int, bytes] = {}
                for i in at:
                    least[root[i]] = min(least.get(root[i], group.f[i]), group.f[i])
                yield pa.RecordBatch.from_arrays([table["f"].take(at).combine_chunks(), pa.array(links[at]), pa.array([least[root[i]] for i in at], pa.binary())], ["f", "links", "least"])

    met = meet_in_blocks(rows, F.ceil(F.col("m") / block), "f", "n", "c", "keys", *sign_columns(rows.columns), "v", "count")
    return met.mapInArrow(run, "f binary, links long, least binary")


def near_duplicates(
    rows: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    miss: float = MISS,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id) of every row."""
    chosen = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    bits = key_bits(rows.count())
    planes = Planes(table_count(threshold, bits, miss), bits)
    most = most_bits(threshold, planes.tables * bits)
    signs = [f"s{i}" for i in range(-(-planes.tables * bits // 64))]
    placed = settle(nodes_of(chosen, planes, len(signs)), "signed")
    nodes = placed.where("f is not null").groupBy("f", "keys", *signs, "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("count"))
    nodes = settle(nodes, "vector-nodes")
    banded = nodes.select(F.explode("keys").alias("key"), "f")
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = settle(banded.join(buckets, "key"), "members")
    narrow = nodes.select("f", F.lit(1).cast("long").alias("n"), F.col("f").alias("c"), "keys", *signs)
    likely = settle(likely_nodes(members.join(narrow, "f"), most, block=block), "likely")
    sizes = likely.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    full = likely.join(sizes, "key").join(narrow.join(nodes.select("f", "v", "count"), "f"), "f")
    found = settle(links_in_blocks(full, most, threshold, block), "vector-links")
    parts = components(found, "f", "least")

    links = found.groupBy("f").agg(F.sum("links").alias("links"))
    named = nodes.select("f", "rep", "count").join(parts.select(F.col("node").alias("f"), "component"), "f", "left").withColumn("component", F.coalesce("component", "f"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_node = named.join(least, "component").join(links, "f", "left")
    by_node = by_node.select("f", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"), "component_id")
    linked = placed.where("f is not null").select("vec_id", "f").join(by_node, "f").select("vec_id", "n_links", "component_id")
    alone = placed.where("f is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)
