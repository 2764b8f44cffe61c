"""Merkle manifest of a dataset: a content-addressed tree, and a proof of membership for every row.

Every row is a leaf: the SHA-256 of its columns. The leaves of a source, in the order of their ids, are joined in runs of
``fan_out`` consecutive digests until one is left, the source's subroot; the subroots, in the order of their sources, are joined
likewise into the root. Inner nodes are kept as records (digest, children) in one store, found by digest alone.

A proof is found by descent: requests start at the root; the digits of their rank, in base ``fan_out``, choose a child in each
record, and the children that were not chosen are collected as a segment of the path. Requests that share a path so far are one row,
so a step has at most as many rows as the tree has nodes at that depth, and the long paths of single leaves are never
shuffled: the last step hashes them where it finds them. Segments are prepended, so the finished path reads from the leaf to the root.

Ranks come from a range sort over narrow rows (ids and digests; texts are read once, to be hashed), so a source that holds most rows is
spread over many tasks, and so are repeated rows. Digests are SHA-256 over hexadecimal text and stored as 32 bytes.

Defined cases: null columns are hashed as ``-``; a null id or source comes first; rows with equal source and id are ordered by their
leaf; equal rows are leaves of their own and exchangeable; a source of one row has that row's leaf as its subroot; an empty table has no
root (None) and no proofs. Other columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators.joining import attach_settled
from evenkeel.operators.ranking import row_positions
from evenkeel.workspace import settle

FAN_OUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a stored digest.
WIDTH = 32


def field(value: Column) -> Column:
    """A value as it is hashed: its length in bytes, a colon and the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def hex_text(digests: Column) -> Column:
    """Stored digests, one or several in a row, as the text that is hashed."""
    return F.lower(F.hex(digests))


def digest_of(digests: Column) -> Column:
    return F.unhex(F.sha2(hex_text(digests), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def height(count: Column, fan_out: int = FAN_OUT) -> Column:
    """Levels between ``count`` nodes and the one they are joined to."""
    powers = [fan_out**k for k in range(64) if fan_out**k < 1 << 62]
    return sum((F.when(count > F.lit(p), 1).otherwise(0) for p in powers), F.lit(0))


def digits(rank: Column, count: Column, fan_out: int = FAN_OUT) -> Column:
    """The rank in base ``fan_out`` (at most 36), one character per level from the top."""
    return F.lpad(F.conv(rank.cast("string"), 10, fan_out), height(count, fan_out), "0")


def join_runs(nodes: DataFrame, by: str, fan_out: int = FAN_OUT) -> tuple[DataFrame, list[DataFrame]]:
    """Joins the nodes (by, rank, digest, n) of every group until one is left.

    Returns (by, digest, n) with the group's root and its number of nodes, and the settled records (digest, children) of each level.
    """
    levels, tops = [], []
    level = nodes.withColumn("left", F.col("n"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 0:
        tops.append(level.where("left = 1").select(by, "digest", "n"))
        if most == 1:
            break
        run = F.call_function("div", F.col("rank"), F.lit(fan_out))
        in_order = F.sort_array(F.collect_list(F.struct("rank", "digest")))
        text = F.array_join(F.transform(in_order, lambda x: hex_text(x["digest"])), "")
        joined = level.where("left > 1").groupBy(by, run.alias("rank"), "n", "left").agg(F.unhex(text).alias("children"))
        level = joined.select(
            by, "rank", "n", F.ceil(F.col("left") / fan_out).alias("left"), digest_of(F.col("children")).alias("digest"), "children"
        )
        level = settle(level, "merkle-level")
        levels.append(level.select("digest", "children"))
        level = level.drop("children")
        most = -(-most // fan_out)
    if not tops:
        return nodes.select(by, "digest", "n"), []
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out, levels


@dataclass
class Dag:
    """``store`` has (digest, children), ``subroots`` (_source, source_rank, subroot, n), ``leaves`` the ranked rows and ``requests``
    their paths; all are settled tables. ``root`` is the root's digest in hexadecimal, None for an empty table."""

    store: DataFrame
    subroots: DataFrame
    requests: DataFrame
    root: str | None
    fan_out: int


def build(leaves: DataFrame, order: Sequence[str], fan_out: int = FAN_OUT) -> Dag:
    """The tree over ``leaves`` (source, digest, further columns that ``requests`` keeps); leaves of a source are ordered by ``order``."""
    # A key that is never null and sorts as null, then by bytes.
    keyed = leaves.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    keyed = settle(keyed.drop("source"), "merkle-leaves")
    # The last column only tells equal rows apart, so that a crowd of them can be cut into ranges.
    numbered = keyed.withColumn("_equal", F.monotonically_increasing_id())
    ranked = settle(row_positions(numbered, ["_source"], [*order, "digest", "_equal"], "rank").drop("_equal"), "merkle-ranks")
    counts = settle(ranked.groupBy("_source").agg(F.count(F.lit(1)).alias("n")), "merkle-sources")
    nodes = attach_settled(ranked.select("_source", "rank", "digest"), counts, ["_source"])
    roots, levels = join_runs(nodes, "_source", fan_out)

    subroots = settle(roots.withColumnRenamed("digest", "subroot").withColumn("_all", F.lit(0)), "merkle-subroots")
    placed = settle(row_positions(subroots, ["_all"], ["_source"], "source_rank"), "merkle-subroots")
    sources = placed.count()
    top = placed.select("_all", F.col("source_rank").alias("rank"), F.col("subroot").alias("digest"), F.lit(sources).cast("long").alias("n"))
    above, upper = join_runs(top, "_all", fan_out)
    first = above.select(hex_text(F.col("digest")).alias("root")).first()
    records = levels + upper
    store = None
    for record in records:
        store = record if store is None else store.unionByName(record)
    if store is None:
        store = ranked.select("digest", F.col("digest").alias("children")).limit(0)
    store = settle(store.dropDuplicates(["digest"]), "merkle-store")

    placed = placed.select("_source", "source_rank", "subroot", "n")
    path = F.concat(digits(F.col("source_rank"), F.lit(sources), fan_out), digits(F.col("rank"), F.col("n"), fan_out))
    own = [c for c in ranked.columns if c not in ("_source", "rank")]
    requests = attach_settled(ranked, placed, ["_source"]).select(path.alias("path"), "subroot", *own)
    return Dag(store, placed, settle(requests, "merkle-requests"), first[0] if first else None, fan_out)


def _step(frontier: DataFrame, store: DataFrame, wanted: DataFrame, fan_out: int) -> DataFrame:
    """One level down: every wanted child (``item.digit``) of the frontier's nodes, with the children that were not chosen as
    the newest segment of its path."""
    at = F.conv(F.col("item.digit"), fan_out, 10).cast("int")
    child = F.substring(F.col("children"), at * WIDTH + 1, F.lit(WIDTH))
    segment = F.struct(
        F.substring(F.col("children"), F.lit(1), at * WIDTH).alias("before"),
        F.substring(F.col("children"), (at + 1) * WIDTH + 1, F.lit(fan_out * WIDTH)).alias("after"),
    )
    met = frontier.join(wanted, "path").join(store, "digest").withColumn("item", F.explode("items"))
    return met.select("path", "item", child.alias("digest"), F.concat(F.array(segment), F.col("segments")).alias("segments"))


def prove(dag: Dag, requests: DataFrame | None = None) -> DataFrame:
    """The requests' columns with ``digest`` as found by descent and ``segments``, the siblings before and after, from leaf to root.

    ``requests`` has a ``path`` of digits, one row per leaf; None stands for every leaf of the tree.
    """
    requests = dag.requests.drop("digest") if requests is None else requests
    spark, own = requests.sparkSession, requests.columns
    kind = "array<struct<before:binary,after:binary>>"
    last = F.substring("path", -1, 1)
    parent = F.expr("substring(path, 1, length(path) - 1)")
    asked = requests.select(parent.alias("path"), F.length("path").alias("_depth"), F.struct(last.alias("digit"), *own).alias("item"))
    if dag.root is None:
        empty = requests.limit(0)
        return empty.select(*own, F.lit(None).cast("binary").alias("digest"), F.lit(None).cast(kind).alias("segments"))
    depths = sorted(r[0] for r in requests.select(F.length("path")).distinct().collect())
    start = spark.range(1).select(F.lit("").alias("path"), F.unhex(F.lit(dag.root)).alias("digest"), F.expr(f"cast(array() as {kind})").alias("segments"))
    found = []
    if depths[:1] == [0]:  # a tree of one leaf
        found.append(requests.where("path = ''").join(start, "path").select(*own, "digest", "segments"))
    arrivals = {}
    for depth in depths:
        if depth:
            items = asked.where(F.col("_depth") == depth).groupBy("path").agg(F.collect_list("item").alias("items"))
            arrivals[depth] = settle(items, "merkle-asked")
    # Inner nodes on the way, from the deepest up: each table has about one row for fan_out rows of the one below.
    inner: dict[int, DataFrame] = {}
    for depth in range(max(depths, default=0) - 1, 0, -1):
        paths = [table.select("path") for table in (arrivals.get(depth + 1), inner.get(depth + 1)) if table is not None]
        both = paths[0] if len(paths) == 1 else paths[0].unionByName(paths[1])
        items = both.distinct().select(parent.alias("path"), F.struct(last.alias("digit")).alias("item"))
        inner[depth] = settle(items.groupBy("path").agg(F.collect_list("item").alias("items")), "merkle-inner")
    frontier = start
    for depth in range(1, max(depths, default=0) + 1):
        if depth in arrivals:
            reached = _step(frontier, dag.store, arrivals[depth], dag.fan_out)
            found.append(reached.select(*[F.col("item")[c].alias(c) for c in own], "digest", "segments"))
        if depth in inner:
            down = _step(frontier, dag.store, inner[depth], dag.fan_out)
            frontier = settle(down.select(F.concat("path", "item.digit").alias("path"), "digest", "segments"), "merkle-frontier")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def siblings_text(segments: Column) -> Column:
    """All siblings of a path, from the leaf to the root and left to right."""
    return F.array_join(F.transform(segments, lambda s: F.concat(hex_text(s["before"]), hex_text(s["after"]))), "")


def fold(leaf: Column, segments: Column) -> Column:
    """The root that a leaf (hexadecimal) and its path lead to."""
    return F.aggregate(segments, leaf, lambda acc, s: F.sha2(F.concat(hex_text(s["before"]), acc, hex_text(s["after"])), 256))


def manifest(docs: DataFrame, fan_out: int = FAN_OUT, checked: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, segments, check_leaf) of every row.

    ``checked`` is the text to be checked against the tree, null where it is the stored one; ``check_leaf`` is the leaf of the row with it.
    """
    others = [F.col(c) for c in COLUMNS[:-1]]
    stored = leaf_digest(*others, F.col("text"))
    changed = F.lit(None).cast("binary") if checked is None else F.when(checked.isNotNull(), leaf_digest(*others, checked))
    leaves = docs.select("doc_id", F.col("source").cast("string").alias("source"), stored.alias("digest"), changed.alias("changed"))
    dag = build(leaves, ["doc_id"], fan_out)
    proofs = prove(dag)
    return proofs.select(
        "doc_id",
        hex_text(F.col("digest")).alias("leaf"),
        hex_text(F.col("subroot")).alias("subroot"),
        F.lit(dag.root).cast("string").alias("root"),
        "segments",
        hex_text(F.coalesce("changed", "digest")).alias("check_leaf"),
    )
