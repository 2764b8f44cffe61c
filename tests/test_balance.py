import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evenkeel.operators import balance, joining, profile, ranking, splits


def examples(spark, labels_by_dataset):
    rows = [(d, i, f"text {i}", y) for d, labels in labels_by_dataset.items() for i, y in enumerate(labels)]
    return spark.createDataFrame(rows, "dataset_id string, row_id long, text string, label int")


def counts(df, *keys):
    return {tuple(r)[:-1]: r["count"] for r in df.groupBy(*keys).count().collect()}


def test_duplicate_minority_edges(spark):
    df = examples(
        spark,
        {"one": [1, 1, 1], "even": [0, 1], "three": [0, 1, 1, 2, 2, 2], "nine": [1, 0, 1, 1, 1, 0, 1, 1, 1]},
    )
    out = balance.duplicate_minority(df).cache()
    by_class = counts(out, "dataset_id", "label")
    assert by_class[("one", 1)] == 3
    assert by_class[("even", 0)] == by_class[("even", 1)] == 1
    assert [by_class[("three", y)] for y in (0, 1, 2)] == [3, 2, 3]
    assert by_class[("nine", 0)] == by_class[("nine", 1)] == 7
    rows = counts(out.where("dataset_id = 'nine' and label = 0"), "row_id")
    assert rows == {(1,): 4, (5,): 3}
    assert out.where("copy = 0").count() == df.count()


def test_many_copies_are_shared_out_in_chunks(spark):
    df = examples(spark, {"a": [0] * 3 + [1] * 100, "b": [0, 0, 1], "c": [0] * 20 + [1] * 50})
    whole = balance.duplicate_minority(df)
    chunked = balance.duplicate_minority(df, chunk=7)
    assert whole.exceptAll(chunked).isEmpty() and chunked.count() == whole.count() == 304


def test_first_seen_class_wins_a_tie(spark):
    df = examples(spark, {"d": [2, 1, 1, 2, 0, 0, 0]})
    assert profile.balance_need(df).first().minority_label == 2


SIZES = {"n10": (10, 2, 1), "n11": (11, 3, 1), "n5": (5, 1, 1), "n4": (4, 1, 1), "n15": (15, 3, 1), "n101": (101, 21, 8)}


def test_split_sizes(spark):
    df = examples(spark, {name: [i % 2 for i in range(n)] for name, (n, _, _) in SIZES.items()})
    parts = splits.train_test_split(df).cache()
    n_split = counts(parts, "dataset_id", "split")
    val = counts(splits.train_val_split(parts.where("split = 'train'")), "dataset_id", "part")
    for name, (n, n_test, n_val) in SIZES.items():
        assert n_split[(name, "test")] == n_test and n_split[(name, "train")] == n - n_test
        assert val[(name, "val")] == n_val
    assert parts.select("dataset_id", "row_id").distinct().count() == df.count()
    again = splits.train_test_split(df.repartition(7))
    columns = ["dataset_id", "row_id", "split"]
    assert again.select(columns).exceptAll(parts.select(columns)).isEmpty()


def test_resolve_splits(spark):
    rows = [("own", i, "train" if i < 6 else "test" if i < 8 else "extra") for i in range(10)]
    rows += [("flat", i, None) for i in range(10)] + [("train only", i, "train") for i in range(10)]
    df = spark.createDataFrame(rows, "dataset_id string, row_id long, split string")
    out = counts(splits.resolve_splits(df), "dataset_id", "split")
    assert out == {
        ("own", "train"): 6,
        ("own", "test"): 2,
        ("flat", "train"): 8,
        ("flat", "test"): 2,
        ("train only", "train"): 8,
        ("train only", "test"): 2,
    }
    with pytest.raises(Exception, match="no usable split"):
        splits.resolve_splits(df.withColumn("split", F.lit("extra"))).count()


def brute_first(df, quota):
    order = Window.partitionBy("g").orderBy("key", "id")
    return df.withColumn("r", F.row_number().over(order)).where(f"r <= {quota}").select("g", "id")


@pytest.mark.parametrize("cell_rows, domain", [(10**6, None), (100, None), (100, (-(10**14), 10**15))])
def test_cut_is_exact_for_hot_groups_and_equal_keys(spark, cell_rows, domain):
    """One group holds most rows and half of its keys are equal."""
    key = F.when(F.col("id") % 2 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**15)) - 10**14)
    df = spark.range(6000).select(F.when(F.col("id") % 9 == 0, F.col("id") % 5).otherwise(0).alias("g"), "id", key.alias("key"))
    df = df.repartition(5)
    quota = F.when(F.col("g") == 1, F.col("n") + 5).when(F.col("g") == 2, 0).otherwise(F.floor(F.col("n") * 0.6))
    out = ranking.mark_first(df, ["g"], F.col("key"), F.col("id"), quota, "first", cell_rows, domain).where("first")
    size = df.groupBy("g").count()
    expected = brute_first(df.join(size, "g"), "case g when 1 then count when 2 then 0 else floor(count * 0.6) end")
    assert out.select("g", "id").exceptAll(expected).isEmpty() and expected.exceptAll(out.select("g", "id")).isEmpty()


def test_cut_takes_none_or_all(spark):
    df = spark.range(20).select((F.col("id") % 2).alias("g"), "id")
    quota = spark.createDataFrame([(0, 0), (1, 99)], "g long, k long")
    out = ranking.first_n(df, ["g"], F.col("id"), F.col("id"), quota)
    assert counts(out, "g") == {(1,): 10}


def test_row_positions(spark):
    df = spark.range(500).select(F.when(F.col("id") % 5 == 0, F.col("id") % 3).otherwise(9).alias("g"), (F.col("id") * 7 % 500).alias("k"))
    out = ranking.row_positions(df.repartition(6), ["g"], ["k"])
    expected = df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert out.exceptAll(expected.select(*out.columns)).isEmpty() and out.count() == 500


def test_undersampling_keeps_the_minority_whole(spark):
    df = examples(spark, {"d": [0] * 7 + [1] * 30, "one": [1] * 4})
    out = balance.undersample_random(df).cache()
    assert counts(out, "dataset_id", "label") == {("d", 0): 7, ("d", 1): 7, ("one", 1): 4}


def test_shuffle_does_not_depend_on_partitions(spark):
    df = spark.range(50)
    first = [r.id for r in ranking.shuffle_rows(df.repartition(3), 42, "id").collect()]
    second = [r.id for r in ranking.shuffle_rows(df.repartition(8), 42, "id").collect()]
    assert first == second != sorted(first) and sorted(first) == list(range(50))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_attach_beyond_the_broadcast_bound(spark, how):
    """Hot keys are split off; the result equals a plain join."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 != 0, 1).otherwise(F.col("id") % 2000).alias("k"), "id")
    lookup = spark.range(0, 4000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).union(
        spark.sql("select 1L, 11L")
    )
    got = joining.attach(rows, lookup, ["k"], how, max_rows=10)
    expected = rows.join(lookup, "k", how)
    assert got.exceptAll(expected).isEmpty() and got.count() == expected.count()


def test_profile(spark):
    df = examples(spark, {"d": [0, 1, 1, -1], "one": [1, 1]})
    out = {r.dataset_id: (r.total, r.imbalance_ratio) for r in profile.imbalance_summary(df).collect()}
    assert out == {"d": (3, 2.0), "one": (2, 1.0)}
    entry = profile.distribution_entry(df).where("dataset_id = 'd'").first()
    assert entry.counts == {"0": 1, "1": 2} and entry.total == 3
    shares = {(r.dataset_id, r.label): r.percent for r in profile.class_shares(df).collect()}
    assert shares[("d", 1)] == 50.0
    with pytest.raises(ValueError):
        profile.imbalance_summary(df.where("label < 0"), strict=True)


def test_random_label_sets_end_balanced(spark):
    rng = random.Random(7)
    sets = {f"d{i}": [int(rng.random() < rng.random()) for _ in range(rng.randint(2, 40))] for i in range(12)}
    out = balance.duplicate_minority(examples(spark, sets)).groupBy("dataset_id", "label").count().collect()
    for name, labels in sets.items():
        sizes = {r.label: r["count"] for r in out if r.dataset_id == name}
        largest = max(labels.count(0), labels.count(1))
        assert set(sizes) == set(labels) and all(v == largest for v in sizes.values())
        assert math.isfinite(largest)
