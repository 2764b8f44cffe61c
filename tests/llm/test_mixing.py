import math
import random
import re

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import mixing
from evenkeel.workspace import settle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(d, t, s, 7, "k") for d, t, s in rows], "doc_id long, text string, source string, size int, target string")


def expected_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / open_ for s in names}
        above = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for source, n in (("b", 900), ("a", 120), ("é", 80), ("Z", 60), (None, 90), ("tiny", 2), ("nothing", 3)):
        for _ in range(n):
            size = 0 if source == "nothing" else rng.choice((1, 5, 30, 30, 60, 400))
            rows.append((len(rows), rng.choice((" ", "\n ", "  ")).join(["wörd"] * size), source))
    return rows + [(5000, None, "a"), (5001, "", "b"), (5002, "x " * 20_000, "b"), (None, "some words here", "a")]


def test_targets_and_copies(spark):
    rows = corpus()
    out = mixing.mix(table(spark, rows)).collect()
    sizes, taken, target = {}, {}, {}
    source = {d: s for d, _, s in rows}
    texts = {d: t for d, t, _ in rows}
    for r in out:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and 0 <= r["copies"] <= 3
        assert r["size"] or r["copies"] == 1
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
        target[s] = r["target"]
    assert len(out) == len(rows) and all(r["source_size"] == sizes[source[r["doc_id"]]] for r in out)
    want = expected_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(30, 0.01 * want[s])


def test_result_does_not_depend_on_partitions(spark):
    rows = table(spark, corpus(2))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(mixing.mix(rows.repartition(7))) == key(mixing.mix(rows.coalesce(1)))


def test_duals_meet_their_constraints(spark):
    rows = settle(mixing.measured(table(spark, corpus(3))))
    sizes = settle(rows.groupBy("_k", "_size").agg(F.count(F.lit(1)).alias("n")))
    words = F.col("_size") * F.col("n")
    sums = sizes.groupBy("_k").agg(F.sum(words).alias("source_size"), F.sum("n").alias("docs"), F.sum(words * F.col("_size").cast("double")).alias("squares"))
    for share in (0.02, 0.7, 1.0, 2.9):
        solved = mixing.duals(sizes, settle(sums.withColumn("target", F.col("source_size") * share))).collect()
        counts = {}
        for k, size, n in sizes.collect():
            counts.setdefault(k, []).append((size, n))
        for r in solved:
            if r["source_size"]:
                got = sum(n * s * 3 / (1 + 2 * math.exp(min(700, -r["dual"] * s / r["mean"]))) for s, n in counts[r["_k"]] if s)
                assert got == pytest.approx(r["target"], rel=1e-6)


def test_repeating_rows(spark):
    rows = table(spark, corpus(4))
    repeated = mixing.repeat_rows(rows)
    assert repeated.columns == rows.columns
    copies = {str(r["doc_id"]): r["copies"] for r in mixing.mix(rows).collect()}
    counts = {str(r["doc_id"]): r["count"] for r in repeated.groupBy("doc_id").count().collect()}
    assert counts == {d: c for d, c in copies.items() if c}


def test_empty_and_single(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    (row,) = mixing.mix(table(spark, [(1, "a b c", None)])).collect()
    assert (row["target"], row["copies"]) == (3.0, 1)
    twice = mixing.mix(table(spark, [(1, "a b c", "s"), (1, "a b c", "s")])).collect()
    assert twice[0] == twice[1]
