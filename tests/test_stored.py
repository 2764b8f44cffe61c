import os

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import hooks, upsert
from evenkeel.plans import prepare
from evenkeel.sinks import versions
from evenkeel.sinks.tables import materialise, stored_keys

LOG = "dataset_id string, macro_f1 double"


def evaluated(spark, **values):
    return spark.createDataFrame([(d, float(v), True) for d, v in values.items()], f"{LOG}, success boolean")


def log(spark, root, version=None):
    return {r.dataset_id: r.macro_f1 for r in versions.read_version(spark, root, LOG, version).collect()}


def test_versions_replace_each_other(spark, tmp_path):
    root = str(tmp_path / "log")
    assert log(spark, root) == {}
    assert versions.upsert_version(evaluated(spark, a=1, b=2), root, LOG, upsert.upsert_metrics) == 1
    assert versions.upsert_version(evaluated(spark, b=3, c=4), root, LOG, upsert.upsert_metrics) == 2
    assert log(spark, root) == {"a": 1, "b": 3, "c": 4} and log(spark, root, 1) == {"a": 1, "b": 2}


def test_interrupted_write_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "log")
    versions.upsert_version(evaluated(spark, a=1), root, LOG, upsert.upsert_metrics)
    with monkeypatch.context() as patch:
        patch.setattr(versions, "rename_new", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            versions.upsert_version(evaluated(spark, a=9), root, LOG, upsert.upsert_metrics)
    assert log(spark, root) == {"a": 1}
    versions.upsert_version(evaluated(spark, b=2), root, LOG, upsert.upsert_metrics)
    assert log(spark, root) == {"a": 1, "b": 2}


def test_competing_writers(spark, tmp_path):
    root = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1.0)], LOG)
    versions.write_version(rows, root, 0)
    with pytest.raises(versions.Conflict):
        versions.write_version(spark.createDataFrame([("z", 0.0)], LOG), root, 0)
    assert log(spark, root) == {"a": 1}
    raced = []

    def merge(existing, incoming):
        if not raced:  # another writer comes between reading and naming
            raced.append(versions.write_version(spark.createDataFrame([("a", 1.0), ("b", 5.0)], LOG), root, 1))
        return upsert.upsert_metrics(existing, incoming)

    assert versions.upsert_version(evaluated(spark, c=3), root, LOG, merge) == 3
    assert log(spark, root) == {"a": 1, "b": 5, "c": 3}
    with pytest.raises(versions.Conflict):
        versions.upsert_version(evaluated(spark, d=1), root, LOG, lambda e, i: (raced.pop() if raced else 0, versions.write_version(e, root, versions.current_version(spark, root)), upsert.upsert_metrics(e, i))[2], attempts=2)


def examples(spark, datasets="ab"):
    rows = [(d, i, f"word{i % 5} more text {d}", int(i % 4 > 0)) for d in datasets for i in range(24)]
    return spark.createDataFrame(rows, "dataset_id string, row_id long, text string, label int")


def test_finished_datasets_are_not_generated_again(spark, tmp_path):
    root = str(tmp_path / "features")
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(prompts, passes):
            calls.add(len(prompts))
            return [p.split('"')[1] + " indeed<turn|>" if '"' in p else p for p in prompts]

        return model

    generate = hooks.batch_generator(load, prompt=F.col("text"))
    score = hooks.pair_scorer(lambda ours, theirs: [1.0] * len(ours))
    first = sorted(map(tuple, prepare.prepare(examples(spark), "llm_paraphrasing", root, generate, score).collect()))
    generated = calls.value
    assert generated > 0 and {r[1] for r in first} == {"a", "b"}
    again = sorted(map(tuple, prepare.prepare(examples(spark), "llm_paraphrasing", root, generate, score).collect()))
    assert again == first and calls.value == generated
    stored = {tuple(r) for r in prepare.stored(spark, root).collect()}
    more = prepare.prepare(examples(spark, "abc"), "llm_paraphrasing", root, generate, score).collect()
    assert {r.dataset_id for r in more} == {"a", "b", "c"} and calls.value > generated
    assert stored < {tuple(r) for r in prepare.stored(spark, root).collect()}


def test_half_written_datasets_are_done_again(spark, tmp_path):
    root = str(tmp_path / "features")
    counts = prepare.prepare(examples(spark), "baseline", root).collect()
    whole = {tuple(r) for r in prepare.stored(spark, root).collect()}
    kept = spark.read.schema(prepare.MARK_SCHEMA).parquet(f"{root}/_finished").where("dataset_id = 'a'").collect()
    spark.createDataFrame(kept, prepare.MARK_SCHEMA).write.mode("overwrite").parquet(f"{root}/_finished")  # b has files and no mark
    folder = f"{root}/strategy=baseline/dataset_id=b/split=train"
    part = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
    with open(f"{folder}/{part}", "rb") as source, open(f"{folder}/left-{part}", "wb") as target:
        target.write(source.read())
    assert sorted(map(tuple, prepare.prepare(examples(spark), "baseline", root).collect())) == sorted(map(tuple, counts))
    assert {tuple(r) for r in prepare.stored(spark, root).collect()} == whole


def test_order_is_kept_by_the_files(spark, tmp_path):
    root = str(tmp_path / "ordered")
    rows = spark.range(500).select(
        F.when(F.col("id") < 400, "x/y").otherwise("z").alias("dataset_id"), "id", F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("place")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files also of few rows
    try:
        materialise(rows, root, ["dataset_id"], order="place")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r[0] for r in stored_keys(spark, root, ["dataset_id"]).collect()) == ["x/y", "z"]
    for name in os.listdir(root):
        if name.startswith("dataset_id="):
            files = sorted(f for f in os.listdir(f"{root}/{name}") if f.endswith(".parquet"))
            places = [r.place for f in files for r in spark.read.parquet(f"{root}/{name}/{f}").collect()]
            assert places == sorted(places)
    assert len([f for f in os.listdir(f"{root}/dataset_id=x%2Fy") if f.endswith(".parquet")]) > 1
