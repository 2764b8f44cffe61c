import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import quality
from evenkeel.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_unseen_documents_are_told_apart(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, learn=~held_out("key"))
    rows = quality.score(docs.where(held_out()), model).join(labels, "doc_id")
    right = rows.select(F.avg(((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.93


def test_descent_reaches_the_dual_optimum():
    """Against projected gradient steps on the same dual problem."""
    rng = np.random.default_rng(0)
    features = [np.sort(rng.choice(30, 6, replace=False)).astype(np.int32) for _ in range(40)]
    y, ratio = np.where(rng.random(40) > 0.5, 1.0, -1.0), rng.standard_normal(30)
    w = quality.descend(features, y, ratio, np.full(40, 1.0), 300, 1)
    x = np.zeros((40, 31))
    for i, f in enumerate(features):
        v = ratio[f]
        x[i, f], x[i, -1] = v / (np.sqrt(v @ v) + 1e-6), 1.0
    q, alpha = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(40)
    for _ in range(20_000):
        alpha = np.clip(alpha - 0.02 * (q @ alpha - 1), 0, 1)
    primal = lambda v: v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()
    assert primal(w) == pytest.approx(primal((alpha * y) @ x), rel=1e-3)


def test_shapes_and_repeats():
    assert [quality.shape(w) for w in (b"Word,", b"ABC!!", "Éa".encode(), b"12a", b"|")] == ["Xx,", "X!", "Xx", "0x", "|"]
    codes = quality.Codes()
    a, b, c, empty, null = quality.slots_of([b"x y z", b"x y z", b"x x x", b"", None], codes, 1 << 18)
    assert a.tolist() == b.tolist() != c.tolist() and len(empty) == len(null) == 0 and (np.diff(a) > 0).all()


def test_odd_tables(spark):
    schema = "doc_id long, text string, score double, y string"
    docs = spark.createDataFrame([(1, None, 9.0, "k"), (2, "", 9.0, "k"), (3, "some words", 9.0, "k"), (None, "w " * 50_000, 9.0, "k")], schema)
    labels = spark.createDataFrame([(3, 1), (2, None), (None, 0), (4, 7)], "doc_id long, quality int")
    one_class = quality.score(docs, quality.fit(docs, labels))
    assert {round(r["score"], 6) for r in one_class.collect()} == {round(2 / 3, 6)}
    none = quality.score(docs, quality.fit(docs, labels.limit(0)), keep_text=True)
    assert {r["score"] for r in none.collect()} == {0.5} and none.columns == ["doc_id", "text", "y", "score"]
    many = spark.createDataFrame([(i, f"good plain words {i}" if i % 2 else f"BAD!! JUNK!! {i}", 0.0, "") for i in range(60)], schema)
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(many, marks, shards=3)
    rows = quality.score(many.union(docs), model).collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == 64
    assert quality.score(many.limit(0), model).count() == 0
    again = quality.fit(many.repartition(5), marks.repartition(3), shards=3)
    assert np.allclose(model.weights, again.weights)
