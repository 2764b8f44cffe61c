import pytest
from pyspark.sql import functions as F

from evenkeel.operators import metrics


def predictions(spark, groups):
    rows = [(d, "s", i, t, p) for d, pairs in groups.items() for i, (t, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "dataset_id string, strategy string, row_id long, y_true int, y_pred int")


def test_report_by_hand(spark):
    df = predictions(
        spark,
        {
            "plain": [(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)],
            "no negatives": [(1, 1), (1, 0), (1, 1)],
            "third label": [(0, 0), (0, 2), (1, 1), (2, 1)],
        },
    )
    out = {r.dataset_id: r for r in metrics.fairness_report(df).collect()}
    plain = out["plain"]
    assert plain.accuracy == pytest.approx(0.6)
    assert plain.macro_f1 == pytest.approx((0.5 + 2 / 3) / 2)
    assert (plain.tpr_class_0, plain.tpr_class_1) == pytest.approx((0.5, 2 / 3))
    assert plain.tpr_gap == pytest.approx(1 / 6)
    absent = out["no negatives"]
    assert absent.tpr_class_0 == 0.0 and absent.tpr_class_1 == pytest.approx(2 / 3)
    assert absent.macro_f1 == pytest.approx((0.0 + 0.8) / 2)
    third = out["third label"]
    assert third.tpr_class_0 == 1.0 and third.tpr_class_1 == 1.0
    assert third.accuracy == 0.5 and third.macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)
    cells = {r.dataset_id: (r.c00, r.c01, r.c10, r.c11) for r in metrics.confusion_matrix(df).collect()}
    assert cells == {"plain": (1, 1, 1, 2), "no negatives": (0, 0, 1, 2), "third label": (1, 0, 0, 1)}


@pytest.mark.parametrize("score", [metrics.confusion_matrix, metrics.fairness_report])
def test_unknown_true_labels_are_an_error(spark, score):
    with pytest.raises(Exception, match="no true label"):
        score(predictions(spark, {"d": [(2, 0), (3, 1)]})).collect()


def test_precision_and_recall_of_both_classes(spark):
    row = metrics.class_precision_recall(predictions(spark, {"d": [(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)]})).first()
    assert (row.majority_label, row.minority_label) == (1, 0)
    assert (row.precision_majority, row.recall_majority) == pytest.approx((2 / 3, 2 / 3))
    assert (row.precision_minority, row.recall_minority) == pytest.approx((0.5, 0.5))


def test_speedup_needs_both_times(spark):
    rows = [
        ("a", "baseline", 10.0, True, "measured"),
        ("a", "fast", 4.0, True, "measured"),
        ("b", "baseline", 9.0, True, "measured"),
        ("c", "fast", 9.0, True, "measured"),
        ("d", "baseline", 9.0, True, "estimated"),
        ("d", "fast", 3.0, True, "measured"),
        ("e", "baseline", 9.0, None, "measured"),
    ]
    runs = spark.createDataFrame(
        rows, "job_id string, strategy string, elapsed_seconds double, success boolean, elapsed_source string"
    )
    out = metrics.speedup(metrics.measured_only(runs)).collect()
    assert [(r.job_id, r.strategy, r.speedup) for r in out] == [("a", "fast", 2.5)]


def test_gap_is_within_bounds(spark):
    df = spark.range(2000).select(
        (F.col("id") % 40).cast("string").alias("dataset_id"),
        F.lit("s").alias("strategy"),
        F.col("id").alias("row_id"),
        (F.pmod(F.xxhash64("id"), F.lit(3)) > 0).cast("int").alias("y_true"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) > 1).cast("int").alias("y_pred"),
    )
    out = metrics.fairness_report(df)
    assert out.count() == 40
    assert out.where(~(F.col("tpr_gap").between(0, 1) & F.col("macro_f1").between(0, 1))).isEmpty()
