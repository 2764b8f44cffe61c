"""Whitening of embeddings: exact sums, pivoted Cholesky, one-sided Jacobi.

An entry c becomes the whole number ``floor(scale * c) + offset``. Sums, and products of the entries centred at the whole number
nearest to their mean, are gathered exactly as whole numbers, one narrow table of partial sums per task, so a model does not depend on how rows were
partitioned; what is left of the mean is taken off the products exactly, and each covariance is rounded once.

The covariance matrix, whose size is the square of the vectors' length, is factored on the driver by Cholesky with pivoting, which also finds
its rank, and the columns of the factor are made orthogonal by rotations (one-sided Jacobi): their squared
lengths are the eigenvalues, their directions the components. A factor's small columns keep their relative precision, which
products would lose. Rows are then projected task by task.

Defined cases: vectors that are null or empty, or hold null or non-finite entries or ones of 2^34 or more in magnitude, are dropped; so are vectors
that have not the most frequent length (of equally frequent ones the largest). There are no more components than the rank, so constant
vectors, a single row or an empty table give no rows. Repeated rows count and are returned as often as they occur; a null id stays null. The
sum of squares ``deviation`` is null where it is beyond a long. Equal eigenvalues have some orthogonal basis of their space.
Vectors have at most ``MOST_DIMENSIONS`` entries, which bounds what the driver holds; longer ones are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.workspace import settle

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LARGEST = float(1 << 34)
MOST_DIMENSIONS = 2048
#: Sums of doubles are exact below this.
EXACT = 1 << 53
WHOLE = pa.decimal128(38, 0)


def usable(batch: pa.RecordBatch, scale: int, offset: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: positions of the usable vectors of a batch and their whole numbers."""
    column = batch.column("embedding")
    starts = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry is NaN here
    with np.errstate(invalid="ignore"):
        bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < LARGEST))])
    lengths = np.diff(starts)
    valid = column.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    good = valid & (lengths > 0) & (bad[starts[1:]] == bad[starts[:-1]])
    out = {}
    for length in np.unique(lengths[good]).tolist():
        at = np.flatnonzero(good & (lengths == length))
        entries = flat[starts[at][:, None] + np.arange(length)]
        out[length] = at, np.floor(entries * scale).astype(np.int64) + offset
    return out


def decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], WHOLE)


class ExactSum:
    """A sum of whole-number arrays; kept in longs and moved to unbounded numbers before they could overflow."""

    def __init__(self, shape):
        self.near, self.far, self.bound = np.zeros(shape, np.int64), np.zeros(shape, object), 0

    def add(self, values: np.ndarray, bound: int) -> None:
        if self.bound + bound >= 1 << 62 or values.dtype == object:
            self.far, self.near, self.bound = self.far + self.near, np.zeros_like(self.near), 0
        if values.dtype == object or bound >= 1 << 62:
            self.far = self.far + values
        else:
            self.near, self.bound = self.near + values, self.bound + bound

    def total(self) -> np.ndarray:
        return self.far + self.near


def products(centred: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Exact sums of products of the columns, in blocks of rows, with a bound of their entries."""
    most = int(np.abs(centred).max()) if centred.size else 0
    rows = len(centred) if not most else EXACT // (most * most)
    if rows < 8:
        exact = centred.astype(object)
        yield exact.T @ exact, len(centred) * most * most
        return
    for start in range(0, len(centred), rows):
        block = centred[start : start + rows].astype(np.float64)
        yield (block.T @ block).astype(np.int64), len(block) * most * most


def sums(rows: DataFrame, scale: int, offset: int) -> DataFrame:
    """(d, i, n, s): per length d and dimension i, the number of vectors and the sum of their entries, per task."""

    def run(batches):
        counts, totals = {}, {}
        for batch in batches:
            for d, (at, x) in usable(batch, scale, offset).items():
                totals.setdefault(d, ExactSum(d)).add(x.sum(axis=0), int(np.abs(x).max()) * len(at))
                counts[d] = counts.get(d, 0) + len(at)
        for d, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, counts[d])), decimals(total.total())],
                ["d", "i", "n", "s"],
            )

    return rows.mapInArrow(run, "d int, i int, n long, s decimal(38,0)")


def scatter(rows: DataFrame, centre: list[int], scale: int, offset: int) -> DataFrame:
    """(i, j, v) for i <= j: sums of products of the entries centred at ``centre``, per task."""
    d, upper = len(centre), np.triu_indices(len(centre))

    def run(batches):
        total, some = ExactSum((d, d)), False
        for batch in batches:
            _, x = usable(batch, scale, offset).get(d, (None, np.zeros((0, d), np.int64)))
            for product, bound in products(x - np.array(centre)):
                total.add(product, bound)
                some = True
        if some:
            values = decimals(total.total()[upper])
            yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), values], ["i", "j", "v"])

    return rows.mapInArrow(run, "i int, j int, v decimal(38,0)")


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """L with ``L @ L.T == matrix``, one column per rank; rows are in the matrix's order."""
    left, d = matrix.copy(), len(matrix)
    factor, limit = np.zeros((d, d)), d * np.finfo(float).eps * max(matrix.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        pivot = int(np.argmax(left.diagonal()))
        if left[pivot, pivot] <= limit:
            return factor[:, :k]
        column = left[:, pivot] / np.sqrt(left[pivot, pivot])
        factor[:, k] = column
        left -= np.outer(column, column)
        left[pivot, :] = left[:, pivot] = 0.0  # exactly, so that no pivot is taken twice
    return factor


def jacobi(factor: np.ndarray, most_sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated until they are orthogonal, by falling length.

    A sweep meets every two columns once, in rounds of disjoint pairs that are rotated together.
    """
    columns, rank = factor.copy(), factor.shape[1]
    ring = list(range(rank + rank % 2))
    limit = max(rank, 8) * np.finfo(float).eps
    for _ in range(most_sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[half:][::-1]) if max(a, b) < rank]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            a, b = columns[:, p], columns[:, q]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            size = np.sqrt(alpha * beta)
            off = np.abs(gamma) / np.where(size > 0, size, 1)
            worst = max(worst, off.max())
            turn = off > limit
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
            s = np.where(turn, c * t, 0.0)
            columns[:, p], columns[:, q] = c * a - s * b, s * a + c * b
        if worst <= limit:
            break
    return columns[:, np.argsort(-(columns * columns).sum(axis=0), kind="stable")]


@dataclass
class Model:
    """``centre`` + ``rest`` is the mean; ``remainder`` the sum of the entries centred at ``centre``; ``components`` are unit columns."""

    n: int
    centre: list[int]
    remainder: list[int]
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: int
    offset: int


def fit(rows: DataFrame, embedding: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> Model:
    vectors = rows.select(F.col(embedding).cast("array<double>").alias("embedding"))
    partial = settle(sums(vectors, scale, offset), "vector-sums")
    chosen = partial.where("i = 0").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if chosen is None:
        return Model(0, [], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, scale, offset)
    d, n = chosen["d"], chosen["n"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; at most {MOST_DIMENSIONS} are supported")
    total = [int(r["s"]) for r in partial.where(F.col("d") == d).groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()]
    centre = [(2 * s + n) // (2 * n) for s in total]
    remainder = [s - n * c for s, c in zip(total, centre)]
    added = scatter(vectors, centre, scale, offset).groupBy("i", "j").agg(F.sum("v").alias("v"))
    covariance = np.zeros((d, d))
    for i, j, v in added.collect():
        covariance[i, j] = covariance[j, i] = (n * int(v) - remainder[i] * remainder[j]) / (n * n)
    rotated = jacobi(pivoted_cholesky(covariance))
    values = (rotated * rotated).sum(axis=0)
    rest = np.array([r / n for r in remainder])
    return Model(n, centre, remainder, rest, rotated / np.sqrt(values), values, float(covariance.trace()), scale, offset)


def deviations(centred: np.ndarray, model: Model) -> list[int | None]:
    """Per row, the sum of (n * x - sum) ** 2, exactly; None beyond a long."""
    n, rest = model.n, np.array(model.remainder, dtype=object)
    most, d = int(np.abs(centred).max()) if centred.size else 0, centred.shape[1]
    # (n y - r)^2 = n^2 y^2 - 2 n y r + r^2, whose sums over y^2 and y r fit a long unless entries are enormous.
    small = d * most * max(most, n) < 1 << 62
    y, r = (centred, rest.astype(np.int64)) if small else (centred.astype(object), rest)
    squares, crossed, constant = (y * y).sum(axis=1).tolist(), (y @ r).tolist(), int((rest * rest).sum())
    exact = (n * n * a - 2 * n * b + constant for a, b in zip(squares, crossed))
    return [v if v < 1 << 63 else None for v in exact]


def projected(batch: pa.RecordBatch, model: Model, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a batch's vectors, the vectors centred at ``centre``, and their products with the directions."""
    d = len(model.centre)
    at, x = usable(batch, model.scale, model.offset).get(d, (np.zeros(0, np.int64), np.zeros((0, d), np.int64)))
    y = x - np.array(model.centre, np.int64)
    return at, y, (y - model.rest) @ directions


def identity_error(vectors: DataFrame, model: Model, directions: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows."""
    k = directions.shape[1]
    upper = np.triu_indices(k)

    def run(batches):
        product, total, some = np.zeros((k, k)), np.zeros(k), False
        for batch in batches:
            at, _, white = projected(batch, model, directions)
            product, total, some = product + white.T @ white, total + white.sum(axis=0), some or len(at) > 0
        if some:
            i, j = np.concatenate([upper[0], np.arange(k)]), np.concatenate([upper[1], np.full(k, -1)])
            values = np.concatenate([product[upper], total])
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(values)], ["i", "j", "v"])

    gathered = {(i, j): v / model.n for i, j, v in vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect()}
    entries = ((i, j, v - gathered[i, -1] * gathered[j, -1]) for (i, j), v in gathered.items() if j >= 0)
    return max((abs(v - (i == j)) for i, j, v in entries), default=0.0)


def apply(rows: DataFrame, model: Model, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    chosen = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    directions = model.components[:, :components] / np.sqrt(model.eigenvalues[:components])
    k = directions.shape[1]
    explained = model.eigenvalues[:k] / model.trace if k else np.zeros(0)
    error = identity_error(chosen, model, directions) if k else 0.0
    kind = chosen.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, y, white = projected(batch, model, directions)
            ids = pa.array(np.repeat(at, k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(ids),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * k, model.n)),
                    pa.array(deviations(y, model), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, len(at))),
                    pa.array(np.full(len(at) * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    names = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return chosen.mapInArrow(run, names)
