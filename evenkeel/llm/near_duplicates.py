"""MinHash near-duplicates with odd sketches.

A document is the set of its distinct runs of ``shingle`` words (64-bit codes of them); one with fewer words is the whole
sequence as its only shingle. Documents with equal sets are one node from the start, whatever their number. For
every node, ``bands`` x ``band_rows`` MinHash samples are taken. Bands of samples are the buckets in which partners are
looked for, and all samples together are folded into an odd sketch: sample i toggles one bit of a bitmap, so the
exclusive-or of two bitmaps counts the samples in which the nodes differ. A pair is compared by its full sets only if
that estimate is within five standard deviations of the threshold.

Large buckets are not turned into pairs. First each node is compared with one node of each of its buckets (the one that
looks most alike, by sketch), the links found are joined to components, and a bucket whose nodes are then all in one
component is settled. In what remains, all nodes of a bucket are compared by sketch inside tasks, in blocks of bounded
size, to find those with a likely partner in another component; those meet again, in blocks of bounded size, with their full
sets. Each pair is compared in the first bucket it has in common, and a task emits only links that join components, fewer
than it has nodes.

Links are 100 * |A and B| >= threshold * |A or B| on the full sets. A pair at the threshold has no common band with
probability (1 - t^band_rows)^bands: 8e-6 at 0.85 with the defaults, less for more alike pairs.

Null texts and texts without words have an empty set and no links. Repeated rows are nodes' copies like others. Null ids
are allowed and are the last choice for a component's id. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.blocks import BLOCK, Group, groups_of, likely_nodes, meet_in_blocks
from evenkeel.llm.common import LOWER, WordCodes, list_rows, text_slices
from evenkeel.llm.graph import components
from evenkeel.workspace import fits_broadcast, settle

SHINGLE = 5
THRESHOLD = 85  # hundredths
BANDS, BAND_ROWS = 20, 5
SKETCH_WORDS = 8  # of 64 bits
#: Shingles per node for which blocks of full sets are laid out; blocks of longer texts hold fewer nodes.
BLOCK_SHINGLES = 800

FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SIGNS = [f"s{i}" for i in range(SKETCH_WORDS)]


def mixed(h: np.ndarray, factor: np.uint64 = MIX) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * factor
    return h ^ (h >> np.uint64(29))


def shingle_set(codes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct codes of the runs of ``size`` words, or of the whole sequence if it is shorter."""
    size = min(size, len(codes))
    if not size:
        return codes
    h = np.full(len(codes) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * FACTOR + codes[k : len(codes) - size + 1 + k]
    return np.unique(mixed(h))


def sets_of(texts: list[bytes | None], codes: WordCodes, size: int) -> list[np.ndarray]:
    words = [(t or b"").translate(LOWER).split() for t in texts]
    flat = codes.of([w for own in words for w in own])
    ends = np.cumsum([len(own) for own in words])
    return [shingle_set(flat[end - len(own) : end], size) for own, end in zip(words, ends, strict=True)]


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of the whole set."""
    return np.array([mixed(shingles).sum(), mixed(shingles, FACTOR).sum()], np.uint64).tobytes()


class Sampler:
    """MinHash samples of sets, and from the samples of many sets their band keys and odd sketches."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, count = bands, rows, bands * rows
        self.a = (rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, count, np.uint32)[:, None]
        self.index = np.arange(count, dtype=np.uint64) << np.uint64(32)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        """One minimum per hash function."""
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        parts = [(self.a * short[i : i + 4096] + self.b).min(axis=1) for i in range(0, len(short), 4096)]
        return parts[0] if len(parts) == 1 else np.minimum.reduce(parts)

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """One code per set and band: the band's number and its samples."""
        rows = samples.astype(np.uint64).reshape(len(samples), self.bands, self.rows)
        h = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), rows.shape[:2])
        for k in range(self.rows):
            h = mixed(h * FACTOR + rows[:, :, k])
        return h.view(np.int64)

    def sketches(self, samples: np.ndarray) -> np.ndarray:
        """The odd sketch of every set: each (hash function, minimum) toggles one bit."""
        bits = 64 * SKETCH_WORDS
        place = (mixed(samples.astype(np.uint64) + self.index) % np.uint64(bits)).astype(np.int64)
        odd = np.bincount((place + np.arange(len(samples))[:, None] * bits).ravel(), minlength=len(samples) * bits) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(samples), SKETCH_WORDS)


def bits_for(similarity: float, samples: int) -> int:
    """Differing bits that two sketches are expected to have at a similarity."""
    bits = 64 * SKETCH_WORDS
    return math.ceil(bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity))))


def most_bits(threshold: float, samples: int) -> int:
    """Differing bits beyond which a pair is at least five standard deviations below the threshold."""
    lowest = threshold - 5 * math.sqrt(threshold * (1 - threshold) / samples)
    return bits_for(max(0.0, lowest), samples)


def nodes_of(docs: DataFrame, doc_id: str, text: str, shingle: int, bands: int, band_rows: int) -> DataFrame:
    """(doc_id, t, n, f, keys, sketch) per row: hash of its text; size, fingerprint, band keys and sketch of its set."""

    def run(batches):
        codes, sampler = WordCodes(), Sampler(bands, band_rows)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                sets = sets_of(texts, codes, shingle)
                filled = [s for s in sets if len(s)]
                samples = np.stack([sampler.samples(s) for s in filled]) if filled else np.zeros((0, bands * band_rows), np.uint32)
                keys, sketch = sampler.keys(samples).ravel(), sampler.sketches(samples)
                at = pa.array(np.cumsum([len(s) > 0 for s in sets]) - 1, mask=np.array([len(s) == 0 for s in sets]))
                size = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("t"),
                        pa.array(size),
                        pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                        list_rows(pa.array(keys), np.where(size > 0, bands, 0)),
                        *(pa.array(sketch[:, i]).take(at) for i in range(SKETCH_WORDS)),
                    ],
                    ["doc_id", "t", "n", "f", "keys", *SIGNS],
                )

    words = F.col(text).cast("string")
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(words).alias("t"), words.alias("text"))
    return chosen.mapInArrow(run, "doc_id long, t long, n long, f binary, keys array<long>, " + ", ".join(f"{s} long" for s in SIGNS))


def full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(f, s) for the nodes in ``wanted`` (f): their sets, from the texts of one row each that are read again."""
    wanted = settle(wanted.join(nodes.select("f", "rep"), "f"), "wanted")
    hint = F.broadcast if fits_broadcast(wanted) else lambda x: x
    chosen = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("string").alias("text"))
    same = F.col("rep").eqNullSafe(F.col("r"))
    rows = chosen.join(hint(wanted.select(F.col("rep").alias("r")).distinct()), same, "left_semi")

    def run(batches):
        codes = WordCodes()
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                sets = sets_of(texts, codes, shingle)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fingerprint(s) for s in sets], pa.binary()), list_rows(pa.array(np.concatenate(sets).view(np.int64)), np.array([len(s) for s in sets]))],
                    ["f", "s"],
                )

    found = rows.select("text").mapInArrow(run, "f binary, s array<long>")
    # Equal ids may lead to rows of other nodes, and rows may be repeated.
    return settle(found.join(hint(wanted.select("f")), "f", "left_semi").groupBy("f").agg(F.first("s").alias("s")), "sets")


def linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""
    left = pairs.select("a", "b").join(sets.select(F.col("f").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("f").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    compared = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
    return compared.where(100 * F.col("common") >= threshold * (F.col("total") - F.col("common"))).select("a", "b")


def linked_in_blocks(rows: DataFrame, most: int, threshold: int, shingles: int) -> DataFrame:
    """Links (a, b) by full sets (column s) that join the components of the nodes in each group.

    Pairs whose components have been joined in the group meanwhile need no comparison, so a group has fewer links than nodes.
    """

    def run(batches):
        for table in groups_of(batches):
            group = Group(table, most, threshold / 100)
            lists = table["s"].combine_chunks()
            values, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            ends = np.cumsum(group.n)
            mark, links = np.zeros(len(values), bool), []
            for k in range(len(group.left)):
                partners = group.likely(k)
                if not len(partners):
                    continue
                x = group.left[k]
                mine = flat[ends[x] - group.n[x] : ends[x]]
                mark[mine] = True
                for y in partners:
                    if group.component[x] != group.component[y]:
                        common = int(mark[flat[ends[y] - group.n[y] : ends[y]]].sum())
                        if 100 * common >= threshold * (group.n[x] + group.n[y] - common):
                            group.component[group.component == group.component[y]] = group.component[x]
                            links.append((group.f[x], group.f[y]))
                mark[mine] = False
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], ["a", "b"])

    met = meet_in_blocks(rows, F.ceil(F.col("total") / shingles), "f", "n", "c", "keys", *SIGNS, "s")
    return met.mapInArrow(run, "a binary, b binary")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    threshold: int = THRESHOLD,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, t, n_shingles, group, component_id) of every row: hash of its text, size of its set, its component and that one's smallest id."""
    samples, most = bands * band_rows, most_bits(threshold / 100, bands * band_rows)
    rows = settle(nodes_of(docs, doc_id, text, shingle, bands, band_rows), "shingled")
    nodes = settle(rows.where("f is not null").groupBy("f", "n", "keys", *SIGNS).agg(F.min("doc_id").alias("rep")), "nodes")
    sketches = nodes.select("f", "n", *SIGNS)
    banded = nodes.select(F.explode("keys").alias("key"), "f")
    buckets = settle(banded.groupBy("key").agg(F.min("f").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets")
    members = settle(banded.join(buckets, "key"), "members")

    # Each node with the node of its buckets that looks most alike.
    met = members.where("f <> b").select(F.col("f").alias("a"), "b").distinct()
    with_a = met.join(sketches.select(F.col("f").alias("a"), F.struct("n", *SIGNS).alias("x")), "a")
    with_b = with_a.join(sketches.select(F.col("f").alias("b"), F.struct("n", *SIGNS).alias("y")), "b")
    apart = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in SIGNS), F.lit(0))
    alike = (apart <= most) & (100 * F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n"))
    best = with_b.where(alike).groupBy("a").agg(F.min(F.struct(apart.alias("d"), F.col("b").alias("b"))).alias("best"))
    first = settle(best.select("a", F.col("best.b").alias("b")), "first-pairs")
    sets = full_sets(first.select(F.col("a").alias("f")).union(first.select("b")).distinct(), nodes, docs, doc_id, text, shingle)
    links = settle(linked(first, sets, threshold), "first-links")
    found = components(links)

    # Buckets that still hold several components.
    marked = members.join(found.select(F.col("node").alias("f"), "component"), "f", "left").select("key", "m", "f", F.coalesce("component", "f").alias("c"))
    marked = settle(marked, "marked")
    several = marked.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    rest = settle(marked.join(several, "key").join(nodes.select("f", "n", "keys", *SIGNS), "f"), "rest")
    likely = settle(likely_nodes(rest, most, threshold / 100, block), "likely")
    sets = full_sets(likely.select("f").distinct(), nodes, docs, doc_id, text, shingle)
    chosen = rest.join(likely, ["key", "f"])
    totals = chosen.groupBy("key").agg(F.sum("n").alias("total"))
    more = settle(linked_in_blocks(chosen.join(totals, "key").join(sets, "f"), most, threshold, block * BLOCK_SHINGLES), "more-links")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    named = nodes.select("f", "rep").join(found.select(F.col("node").alias("f"), "component"), "f", "left").withColumn("component", F.coalesce("component", "f"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_node = named.join(least, "component").select("f", F.col("component").alias("group"), "component_id")
    columns = ["doc_id", "t", F.col("n").alias("n_shingles")]
    result = rows.where("f is not null").select(*columns, "f").join(by_node, "f").drop("f")
    empty = rows.where("f is null").select(*columns, F.col("f").alias("group"), F.col("doc_id").alias("component_id"))
    return result.select(*empty.columns).unionByName(empty)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, but of each group only one: smallest id, then smallest hash of the text.

    Rows that repeat both id and text are one document, of which one row stays. Documents without words stay.
    """
    grouped = near_duplicates(docs, doc_id, text, **options).where("group is not null")
    grouped = settle(grouped.groupBy("doc_id", "t", "group", "component_id").agg(F.count(F.lit(1)).alias("rows")), "grouped")
    first = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.min("t").alias("t"))
    first = first.select("group", F.col("t").alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("t") == F.col("first"))
    marked = grouped.join(first, "group").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), stays.alias("_stays"), "rows")
    marked = settle(marked, "marked")
    gone, repeated = marked.where("not _stays").select("_d", "_t"), settle(marked.where("_stays and rows > 1").select("_d", "_t"), "repeated")

    def at(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = settle(keys, "keys")
        hint = F.broadcast if fits_broadcast(keys) else lambda x: x
        same = F.col(doc_id).cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_t"))
        return rows.join(hint(keys), same, how)

    kept = at(docs, gone, "left_anti")
    if repeated.isEmpty():
        return kept
    return at(kept, repeated, "left_anti").unionByName(at(kept, repeated, "left_semi").dropDuplicates([doc_id, text]))
