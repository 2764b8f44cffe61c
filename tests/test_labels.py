from pyspark.sql import functions as F

from evenkeel.functions import labels as lab


def test_ratings(spark):
    rows = [(1.0, "a"), (2.0, "a"), (2.5, "a"), (3.0, "a"), (4.0, "  "), (None, "a"), (5.0, ""), (5.0, None)]
    df = spark.createDataFrame(rows, "r double, t string")
    kept = df.where(lab.is_opinion(F.col("r"), F.col("t")))
    out = [(r.r, r.y) for r in kept.select("r", lab.binarise_rating(F.col("r")).alias("y")).collect()]
    assert out == [(1.0, 0), (2.0, 0), (2.5, 1), (4.0, 1)]


def test_scores(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,)], "s int").select(lab.binarise_score(F.col("s")).alias("y"))
    assert [r.y for r in df.collect()] == [0, 1, 1]


def test_keys(spark):
    df = spark.createDataFrame([("a/b/c",), ("bare",)], "k string")
    out = df.select(lab.key_author(F.col("k")).alias("a"), lab.key_name(F.col("k")).alias("n")).collect()
    assert [tuple(r) for r in out] == [("a", "b/c"), (None, "bare")]
    pid = spark.createDataFrame([(3, 17)], "p int, s long").select(
        lab.paraphrase_id(F.col("p"), F.col("s")).alias("pid")
    )
    row = pid.select("pid", lab.paraphrase_pass(F.col("pid")), lab.paraphrase_source(F.col("pid"))).first()
    assert tuple(row) == ("p3_orig_17", 3, 17)


def test_argmax_takes_the_first_of_equal_scores(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7],), ([2.0, 1.0],)], "s array<double>")
    assert [r.y for r in df.select(lab.argmax_label(F.col("s")).alias("y")).collect()] == [1, 0]
