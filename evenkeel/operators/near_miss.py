"""NearMiss-1 and -2 undersampling by their published definition. Not part of what is compared for parity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.operators.joining import attach_settled
from evenkeel.operators.profile import balance_need
from evenkeel.operators.ranking import CELL_ROWS, first_n
from evenkeel.workspace import fits_broadcast, measure, settle

# The minority is sent to the workers as a whole only up to these measured sizes.
MINORITY_ROWS = 50_000
MINORITY_BYTES = 128 * 1024 * 1024
# Majority rows that are compared at once.
BLOCK_ROWS = 4096
# Distances are taken tile by tile: so many points by so many others.
TILE_POINTS = 512
TILE_OTHERS = 2048
# Beyond them the minority is dealt into cells around pivots: about this many rows to a cell, and at most so many pivots a dataset.
ROWS_PER_CELL = 512
PIVOTS = 64
# Bounds are widened by this share, so that rounding rules out no cell.
SLACK = 1e-6
# Distances are compared in steps of a millionth, so that ties do not hang on the last bit.
SCALE = 1_000_000


def selected_distances(points: np.ndarray, others: np.ndarray, k: int, farthest: bool) -> np.ndarray:
    """The k smallest (or largest) Euclidean distances of every point to the others, one row per point.

    Only one tile of the distances is held at a time, however many others there are; the best k so far are merged with each tile's.
    """
    k, sign = min(k, len(others)), -1.0 if farthest else 1.0
    norms, best = (others**2).sum(1), np.empty((len(points), k))
    for i in range(0, len(points), TILE_POINTS):
        own = points[i : i + TILE_POINTS]
        sizes, kept = (own**2).sum(1)[:, None], np.empty((len(own), 0))
        for j in range(0, len(others), TILE_OTHERS):
            part = others[j : j + TILE_OTHERS]
            tile = sizes + norms[j : j + TILE_OTHERS][None, :] - 2 * own @ part.T
            kept = _first_of(np.hstack([kept, _first_of(sign * np.maximum(tile, 0.0), k)]), k)
        best[i : i + TILE_POINTS] = np.sqrt(sign * kept)
    return best


def _first_of(rows: np.ndarray, k: int) -> np.ndarray:
    """The k smallest values of every row, in any order."""
    return np.partition(rows, k - 1, axis=1)[:, :k] if k < rows.shape[1] else rows


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64")


def distances_by_broadcast(majority: DataFrame, minority: DataFrame, k: int, farthest: bool) -> DataFrame:
    """Map-only: every task holds the minority of proven small size."""
    local = minority.toPandas()
    groups = {name: _matrix(part["vector"]) for name, part in local.groupby("dataset_id")}
    shared = majority.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("dataset_id"):
                for start in range(0, len(part), BLOCK_ROWS):
                    piece = part.iloc[start : start + BLOCK_ROWS]
                    kept = selected_distances(_matrix(piece["vector"]), shared.value[name], k, farthest)
                    yield pd.DataFrame(
                        {"dataset_id": name, "row_id": piece["row_id"].to_numpy(), "mean_distance": kept.mean(axis=1)}
                    )

    return majority.mapInPandas(run, "dataset_id string, row_id long, mean_distance double")


def nearest_pivot(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distances = to_pivots(points, pivots)
    cell = distances.argmin(axis=1)
    return cell, distances[np.arange(len(points)), cell]


def to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squared, 0.0))


def cells_in_reach(distances: np.ndarray, sizes: np.ndarray, radii: np.ndarray, k: int, farthest: bool) -> np.ndarray:
    """Which cells can hold one of a point's k nearest (or farthest) rows, by the triangle inequality; points by cells.

    A cell's rows are between ``distance - radius`` and ``distance + radius`` away. Cells that are surely near (far) enough to hold k rows
    bound the k-th distance; a cell that lies beyond that bound with all its rows is ruled out.
    """
    sure, best = (distances - radii, distances + radii) if farthest else (distances + radii, distances - radii)
    order = np.argsort(-sure if farthest else sure, axis=1)
    enough = np.cumsum(sizes[order], axis=1) >= min(k, sizes.sum())
    at = order[np.arange(len(order)), enough.argmax(axis=1)]
    bound = sure[np.arange(len(order)), at][:, None]
    slack = SLACK * (1 + np.abs(bound))
    return (best >= bound - slack if farthest else best <= bound + slack) & (sizes > 0)


def choose_pivots(minority: DataFrame) -> DataFrame:
    """(dataset_id, cell, vector): up to ``PIVOTS`` minority rows of every dataset, by the order of a hash."""
    by = ["dataset_id"]
    number = F.least(F.lit(PIVOTS), F.ceil(F.count(F.lit(1)) / ROWS_PER_CELL))
    quota = settle(minority.groupBy(*by).agg(number.cast("long").alias("k")), "pivot-counts")
    key = F.pmod(F.xxhash64("row_id"), F.lit(1 << 40))
    chosen = first_n(minority.select(*by, "row_id", "vector"), by, key, F.col("row_id"), quota)
    return chosen.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy("row_id")) - 1).alias("cell"), "vector")


def distances_by_pivots(
    majority: DataFrame, minority: DataFrame, k: int, farthest: bool, max_rows: int = MINORITY_ROWS, max_size: int = MINORITY_BYTES
) -> DataFrame:
    """Exact for a minority of any size, without a copy of the majority.

    Minority rows belong to the cell of their nearest pivot. Cells are dealt into parts of bounded size; for each part the majority is scanned once,
    map-only, with that part's rows in the workers, and a row is compared with the cells that its distances to the pivots do not rule out. What
    leaves a task is the k distances of the rows that were compared; they are merged at the end. The driver holds pivots and the rows of one part at a time.
    """
    pivots = settle(choose_pivots(minority), "pivots")
    rows, size = measure(pivots)
    groups = max(1, -(-rows // max_rows), -(-size // max_size))
    found = []
    for number in range(groups):
        # Beyond the bound, datasets are dealt into groups that are handled one after the other.
        own = F.pmod(F.xxhash64("dataset_id"), F.lit(groups)) == number
        found += _of_group(*(df.where(own) if groups > 1 else df for df in (majority, minority, pivots)), k, farthest, max_rows, max_size)
    if not found:
        return majority.select("dataset_id", "row_id", F.lit(None).cast("double").alias("mean_distance")).limit(0)
    partial = reduce(DataFrame.unionByName, found)
    merged = partial.groupBy("dataset_id", "row_id").agg(F.flatten(F.collect_list("kept")).alias("_d"))
    best = F.slice(F.sort_array("_d", asc=not farthest), 1, k)
    mean = F.aggregate(best, F.lit(0.0), lambda a, d: a + d) / F.size(best)
    return merged.select("dataset_id", "row_id", mean.alias("mean_distance"))


def _of_group(majority: DataFrame, minority: DataFrame, pivots: DataFrame, k: int, farthest: bool, max_rows: int, max_size: int) -> list[DataFrame]:
    """(dataset_id, row_id, kept) for every part of the cells."""
    context = majority.sparkSession.sparkContext
    local = pivots.orderBy("dataset_id", "cell").toPandas()
    if not len(local):
        return []
    centres = {name: _matrix(part["vector"]) for name, part in local.groupby("dataset_id")}
    shared = context.broadcast(centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("dataset_id"):
                cell, distance = nearest_pivot(_matrix(part["vector"]), shared.value[name])
                yield pd.DataFrame({"dataset_id": name, "cell": cell, "distance": distance, "row_id": part["row_id"].to_numpy(), "vector": part["vector"]})

    kind = minority.schema["vector"].dataType.simpleString()
    placed = settle(minority.select("dataset_id", "row_id", "vector").mapInPandas(place, f"dataset_id string, cell int, distance double, row_id long, vector {kind}"), "cells")
    counted = placed.groupBy("dataset_id", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).orderBy("dataset_id", "cell").collect()
    shape = {name: (np.zeros(len(m), np.int64), np.zeros(len(m))) for name, m in centres.items()}
    for row in counted:
        shape[row.dataset_id][0][row.cell], shape[row.dataset_id][1][row.cell] = row.n, row.radius
    most = max(1, min(max_rows, max_size // (8 * max(m.shape[1] for m in centres.values()))))
    limits = context.broadcast((centres, shape))
    return [_compare(majority, points, limits, k, farthest) for points in _parts_of(placed, counted, most)]


def _parts_of(placed: DataFrame, counted: Sequence, most: int) -> Iterator[DataFrame]:
    """The placed rows in parts of about ``most`` rows: whole cells together, a larger cell cut by a hash."""
    dealt, part, size = [], 0, 0
    for row in counted:
        cuts = -(-row.n // most)
        if size and size + row.n > most:
            part, size = part + 1, 0
        dealt.append((row.dataset_id, row.cell, part, cuts))
        part, size = (part + cuts, 0) if cuts > 1 else (part, size + row.n)
    table = placed.sparkSession.createDataFrame(dealt, "dataset_id string, cell int, part int, cuts int")
    number = (F.col("part") + F.pmod(F.xxhash64("row_id"), F.col("cuts"))).cast("int")
    # One row per cell, as many as there are pivots, which were measured.
    joined = settle(placed.join(F.broadcast(table), ["dataset_id", "cell"]).withColumn("part", number).drop("cuts"), "parts")
    for i in range(part + (size > 0)):
        yield joined.where(F.col("part") == i)


def _compare(majority: DataFrame, points: DataFrame, limits, k: int, farthest: bool) -> DataFrame:
    """The k smallest (largest) distances of the majority rows to ``points``, for the rows that have a cell of theirs in reach."""
    local = points.select("dataset_id", "cell", "vector").toPandas()
    cells: dict = {}
    for (name, cell), rows in local.groupby(["dataset_id", "cell"]):
        cells.setdefault(name, {})[cell] = _matrix(rows["vector"])
    shared = majority.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, shape = limits.value
        for batch in batches:
            for name, piece in batch.groupby("dataset_id"):
                own = shared.value.get(name)
                for start in range(0, len(piece) if own else 0, BLOCK_ROWS):
                    part = piece.iloc[start : start + BLOCK_ROWS]
                    vectors = _matrix(part["vector"])
                    reach = cells_in_reach(to_pivots(vectors, centres[name]), *shape[name], k, farthest)
                    kept: list[list[float]] = [[] for _ in range(len(part))]
                    for cell, others in own.items():
                        at = np.flatnonzero(reach[:, cell])
                        if len(at):
                            for i, values in zip(at, selected_distances(vectors[at], others, k, farthest).tolist()):
                                kept[i] += values
                    some = [i for i, values in enumerate(kept) if values]
                    best = [sorted(kept[i], reverse=farthest)[:k] for i in some]
                    yield pd.DataFrame({"dataset_id": name, "row_id": part["row_id"].to_numpy()[some], "kept": best})

    return majority.select("dataset_id", "row_id", "vector").mapInPandas(run, "dataset_id string, row_id long, kept array<double>")


def near_miss(
    df: DataFrame,
    farthest: bool = False,
    k: int = 3,
    label: str = "label",
    max_rows: int = MINORITY_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Cut the majority to the minority's size, keeping the rows with the smallest mean distance to their k
    nearest (version 1) or farthest (version 2) minority rows. ``df``: dataset_id, row_id, vector, label."""
    by = ["dataset_id"]
    need = settle(balance_need(df, by, label, "row_id").where(F.col("needed") > 0), "need")
    rare = need.select(*by, F.col("minority_label").alias("_rare"))
    marked = attach_settled(df, rare, by, "left")
    minority = settle(marked.where(F.col(label) == F.col("_rare")).select(*by, "row_id", "vector"), "minority")
    majority = marked.where(F.col(label) != F.col("_rare")).select(*by, "row_id", "vector")
    if fits_broadcast(minority, max_rows, MINORITY_BYTES):
        distances = distances_by_broadcast(majority, minority, k, farthest)
    else:
        distances = distances_by_pivots(majority, minority, k, farthest)
    keyed = distances.select(*by, "row_id", F.round(F.col("mean_distance") * SCALE).cast("long").alias("_far"))
    keyed = settle(keyed, "distances")
    quota = need.select(*by, F.col("minority_count").alias("k"))
    chosen = first_n(keyed, by, F.col("_far"), F.col("row_id"), quota, cell_rows).select(*by, "row_id")
    kept_majority = marked.where(F.col(label) != F.col("_rare")).join(chosen, [*by, "row_id"], "left_semi")
    others = marked.where(F.col("_rare").isNull() | (F.col(label) == F.col("_rare")))
    return others.unionByName(kept_majority).select(*df.columns)
