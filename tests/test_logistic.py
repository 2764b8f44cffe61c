import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import logistic, splits
from evenkeel.operators.balance import duplicate_minority

SCHEMA = "dataset_id string, strategy string, row_id long, text string, label int, part string"


def reviews(spark, n=120):
    return spark.range(n).select(
        F.lit("d").alias("dataset_id"),
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 6 == 0, F.lit("bad poor awful")).otherwise(F.lit("good fine great")).alias("text"),
        (F.col("id") % 6 != 0).cast("int").alias("label"),
    )


def test_models_are_judged_on_the_same_test_rows(spark, tmp_path):
    rows = splits.train_test_split(reviews(spark)).cache()
    train, test = rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")
    base = splits.train_val_split(train).withColumn("strategy", F.lit("baseline"))
    doubled = splits.train_val_split(duplicate_minority(train), row=("row_id", "copy")).drop("copy").withColumn("strategy", F.lit("dup"))
    path = str(tmp_path / "models")
    asked = logistic.fit_missing(base.unionByName(doubled), path, slots=64, steps=8)
    assert sorted((r.strategy, r.skipped) for r in asked.collect()) == [("baseline", False), ("dup", False)]
    models = spark.read.parquet(path)
    out = logistic.predict(test, models).cache()
    ids = {s: sorted(r.row_id for r in out.where(F.col("strategy") == s).collect()) for s in ("baseline", "dup")}
    assert ids["baseline"] == ids["dup"] == sorted(r.row_id for r in test.collect())
    assert {r.strategy: r.macro_f1 for r in logistic.evaluate(test, path).collect()} == {"baseline": 1.0, "dup": 1.0}


def test_stored_models_are_not_fitted_again(spark, tmp_path, monkeypatch):
    rows = reviews(spark, 30).withColumn("part", F.when(F.col("row_id") < 24, "train").otherwise("val"))
    first = rows.withColumn("strategy", F.lit("a"))
    both = first.unionByName(rows.withColumn("strategy", F.lit("b")))
    path = str(tmp_path / "models")
    logistic.fit_missing(first, path, slots=8, steps=2)
    before = spark.read.parquet(path).collect()
    asked = logistic.fit_missing(both, path, slots=8, steps=2)
    assert sorted((r.strategy, r.skipped) for r in asked.collect()) == [("a", True), ("b", False)]
    after = {r.strategy: r for r in spark.read.parquet(path).collect()}
    assert set(after) == {"a", "b"} and after["a"] == before[0]
    monkeypatch.setattr(logistic, "fit", lambda *a, **k: pytest.fail("everything is stored"))
    assert all(r.skipped for r in logistic.fit_missing(both, path).collect())


def plain(rows, slots, slot_of, steps, patience, rate, decay):
    """Weights of the best step, steps taken, best step and loss for rows (text, label, part)."""
    x = np.zeros((len(rows), slots + 1))
    for i, (text, _, _) in enumerate(rows):
        for word in (text or "").split():
            x[i, slot_of[word]] += 1
        norm = np.linalg.norm(x[i])
        x[i] = x[i] / norm if norm else x[i]
    x[:, slots] = 1
    y, val = np.array([r[1] for r in rows], float), np.array([r[2] == "val" for r in rows])
    w, best, best_w, best_step = np.zeros(slots + 1), np.inf, None, 0
    for step in range(steps + 1):
        m = x @ w
        loss = (np.log1p(np.exp(-np.abs(m))) + np.maximum(m, 0) - y * m)[val].mean()
        if step and loss < best:
            best, best_w, best_step = loss, w.copy(), step
        if step == steps or step and step - best_step >= patience:
            return best_w, step, best_step, best
        slope = x[~val].T @ (1 / (1 + np.exp(-m)) - y)[~val] / (~val).sum()
        shrink = np.append(np.full(slots, rate * decay), 0)
        w = w - rate * slope - shrink * w
    return best_w, steps, best_step, best


def test_keys_stop_at_their_own_steps(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    data, talks = [], {}
    for name, noise in (("clean", 0.0), ("noisy", 0.5), ("opposed", 0.2)):
        rows = []
        for i in range(60):
            label = int(i % 2)
            text = " ".join(rng.choice(words[:6] if label else words[6:], 4)) + " " + " ".join(rng.choice(words, 2))
            part = "val" if i >= 45 else "train"
            given = 1 - label if rng.random() < noise or (name == "opposed" and part == "val") else label
            rows.append((text if i else "", given, part))
        talks[name] = rows
        data += [(name, "s", i, text, label, part) for i, (text, label, part) in enumerate(rows)]
    df = spark.createDataFrame(data + [("clean", "s", 99, "w1", None, "train"), ("clean", "s", 100, None, 1, "train")], SCHEMA)
    talks["clean"].append((None, 1, "train"))
    settings = {"slots": 32, "steps": 9, "patience": 2, "rate": 4.0, "decay": 0.01}
    slots = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", logistic.hash_word(F.col("w")) % 32).collect()}
    models = {r.dataset_id: r for r in logistic.fit(df, **settings).collect()}
    assert len({m.steps for m in models.values()}) > 1
    for name, rows in talks.items():
        w, steps, best_step, loss = plain(rows, 32, slots, 9, 2, 4.0, 0.01)
        model = models[name]
        assert (model.steps, model.best_step) == (steps, best_step)
        assert np.allclose(model.weights, w, atol=1e-9) and model.val_loss == pytest.approx(loss, abs=1e-9)


def test_rows_of_a_key_are_not_gathered(spark):
    rows = reviews(spark, 40).withColumn("strategy", F.lit("a")).withColumn("part", F.lit("train"))
    given = logistic.featurise(rows, 8).withColumn("label", F.col("label").cast("double"))
    state = given.select("dataset_id", "strategy").distinct().withColumn("weights", F.array_repeat(F.lit(0.0), 9))
    plan = logistic._cells(given, state, ["dataset_id", "strategy"], 8, True)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("slots" in line for line in exchanges)
    assert "BroadcastExchange" in plan and "partial_sum" in plan, plan


def test_features_are_as_wide_as_their_distinct_slots(spark):
    long = " ".join(f"w{i % 90}" for i in range(5000))
    rows = spark.createDataFrame([(1, long), (2, "B\u2003a  b"), (3, " "), (4, None)], "row_id long, text string")
    found = {r.row_id: r for r in logistic.featurise(rows, 16).collect()}
    spread = spark.createDataFrame([(w,) for w in [*long.split(), "b", "a"]], "w string").select("w", logistic.hash_word(F.col("w")) % 16).distinct()
    place = {r[0]: r[1] for r in spread.collect()}
    for row, words in ((1, long.split()), (2, ["b", "a", "b"]), (3, []), (4, [])):
        counts = np.bincount([place[w] for w in words], minlength=16)
        slots = np.flatnonzero(counts)
        # One entry per word made every step as long as the texts.
        assert found[row].slots == slots.tolist()
        assert np.allclose(found[row].amounts, counts[slots] / max(np.linalg.norm(counts), 1))


def test_empty_input(spark):
    assert logistic.fit(spark.createDataFrame([], SCHEMA), slots=4, steps=2).collect() == []
