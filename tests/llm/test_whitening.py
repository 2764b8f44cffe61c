import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import whitening
from evenkeel.llm.queries import LLM_QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return LLM_QUERIES["op12_whiten"](spark, str(tmp_path))


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.geomspace(0.02, 2, d) + 0.3).astype(np.float32)


@pytest.mark.parametrize("n,d", [(300, 5), (400, 64), (20, 40)])
def test_whitened_against_eigenvectors(spark, tmp_path, n, d):
    v = vectors(n, d)
    rows = table(spark, tmp_path, [(i, x.tolist()) for i, x in enumerate(v)]).collect()
    x = np.floor(v.astype(np.float64) * 64).astype(np.int64) + 1_000_000
    total = x.sum(axis=0)
    centred = x - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(32, d, n - 1)
    assert len(rows) == n * k
    white = np.zeros((n, k))
    for r in rows:
        white[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r.vec_id], total))
    expected = centred @ axes[:, :k] / np.sqrt(values[:k])
    signs = np.sign((white * expected).sum(axis=0))
    assert np.allclose(white, expected * signs, atol=1e-6)


def test_model_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors(200, 8))], "vec_id long, embedding array<float>")
    a, b = whitening.fit(rows.repartition(1)), whitening.fit(rows.repartition(7))
    assert (a.components == b.components).all() and (a.eigenvalues == b.eigenvalues).all()


def test_covariance_is_rounded_once(spark):
    v = vectors(50, 3)
    rows = spark.createDataFrame([(x.tolist(),) for x in v], "embedding array<float>")
    model = whitening.fit(rows)
    x = np.floor(v.astype(np.float64) * 64).astype(np.int64) + 1_000_000
    exact = sum(Fraction(int(a)) ** 2 for a in x.ravel()) / 50 - sum(Fraction(int(s), 50) ** 2 for s in x.sum(axis=0))
    assert model.trace == pytest.approx(float(exact), rel=1e-15)


def test_dropped_rows_ties_and_other_lengths(spark, tmp_path):
    good = vectors(40, 3, seed=2).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[0]), (0, good[0])]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [1.0, float("inf"), 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0])]
    out = table(spark, tmp_path, rows + bad).collect()
    assert len(out) == 42 * 3 and {r.n for r in out} == {42}
    assert {r.vec_id for r in out} == {None, *range(40)}


def test_rank_below_length(spark, tmp_path):
    base = vectors(60, 2, seed=3)
    rows = [(i, [float(round(a * 64) / 64), float(round(a * 64) / 32), 0.5, float(b)]) for i, (a, b) in enumerate(base)]
    out = table(spark, tmp_path, rows).collect()
    assert {r.component for r in out} == {1, 2} and all(r.identity_error < 1e-9 for r in out)
    assert math.isclose(sum({r.component: r.explained for r in out}.values()), 1, rel_tol=1e-12)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [3.0, 4.0]) for i in range(5)]])
def test_no_components(spark, tmp_path, rows):
    assert table(spark, tmp_path, rows).collect() == []


def test_large_entries_are_exact(spark):
    rows = spark.createDataFrame([(i, [float(1 << 33) * (-1) ** i, float(i)]) for i in range(10)], "vec_id long, embedding array<double>")
    model = whitening.fit(rows)
    assert model.eigenvalues[0] == pytest.approx(float(1 << 39) ** 2, rel=1e-12)
    assert whitening.apply(rows, model).where(F.col("deviation").isNotNull()).count() == 0


def test_jacobi_keeps_small_components():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    values = np.geomspace(1e6, 1e-3, 12)
    rotated = whitening.jacobi(q * np.sqrt(values) @ np.linalg.qr(rng.standard_normal((12, 12)))[0])
    assert np.allclose((rotated**2).sum(axis=0), values, rtol=1e-9)
