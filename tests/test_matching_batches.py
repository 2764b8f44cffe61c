"""Greedy matching of pairs in coded batches, and the texts and tokens it is fed with."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.functions.text import ws_tokens
from evenkeel.operators import matching
from evenkeel.plans import tables as t

SCHEMA = "src_id long, paraphrase string, original string"
WORDS = [f"w{i}" for i in range(40)]


def some_pairs(count=30):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(count):
        original = " ".join(rng.choice(WORDS, rng.integers(0, 15)))
        rows += [(i, " ".join(rng.choice(WORDS, rng.integers(0, 15))), original), (i, original, original), (i, None, original), (i, "W1 w2", None)]
    return rows


def test_batches_of_any_size_score_as_the_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(w, rng.normal(size=8).tolist()) for w in WORDS[:30]], "token string, vector array<float>")
    pairs = spark.createDataFrame(some_pairs(), SCHEMA).coalesce(2)

    def scores(max_rows):
        out = matching.greedy_match_f1(pairs, vectors, ["src_id"], max_rows=max_rows, keep=["src_id", "paraphrase"])
        assert out.columns == ["src_id", "paraphrase", "score"]
        return sorted((r.src_id, r.paraphrase or "", round(r.score, 9)) for r in out.collect())

    whole = scores(matching.VECTOR_ROWS)
    assert len(whole) == 120 and any(0 < s < 1 for *_, s in whole)
    for tokens in (1, 20, 10_000):
        monkeypatch.setattr(matching, "BATCH_TOKENS", tokens)
        assert [s[2] for s in scores(3)] == pytest.approx([s[2] for s in whole], abs=1e-6)


def test_no_text_is_sent_along_with_the_codes(spark):
    vectors = spark.createDataFrame([(w, [1.0, 2.0]) for w in WORDS], "token string, vector array<float>")
    scored = matching.greedy_match_f1(spark.createDataFrame(some_pairs(3), SCHEMA), vectors, ["src_id"], max_rows=3, keep=["src_id"])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "_batch" in plan and "original" not in plan and "paraphrase" not in plan


def test_word_drop_keeps_the_places_of_its_rule(spark):
    words = [f"x{i}" for i in range(13)]
    rows = [(row, no, "  ".join(words[:n])) for row in (-6, -5, -3, 0, 1, 2, 3, None) for no in (0, 1, 2, 7) for n in (0, 1, 5, 13)]
    samples = spark.createDataFrame([*rows, (1, 0, None)], "src_id long, pass int, text string")
    for r in samples.withColumn("out", t.varied_word_drop(samples)).collect():
        if r.text is None:
            assert r.out is None
            continue
        turn, no = None if r.src_id is None else math.fmod(r.src_id + r["pass"], 4), r["pass"]
        keep = {0: lambda i: (i + no) % 5 == 0, 1: lambda i: (i + no) % 2 == 0}.get(turn, lambda i: (i + no) % 5 != 0)
        assert r.out.split(" ") == ([w for i, w in enumerate(r.text.split()) if keep(i)] or [""])


def test_distinct_tokens_are_those_of_the_columns(spark):
    texts = ["It's A test", "a\x1cb\x85c", "", None, "ΑΣ İ a a", "\t x  y　"]
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    expected = {r[0] for r in docs.select(F.explode(ws_tokens(F.col("text")))).collect()}
    found = [r[0] for r in t.distinct_tokens(docs).collect()]
    assert set(found) == expected and len(found) == len(expected)


def test_keys_of_a_stream_share_few_calls_and_lose_nothing(spark, tmp_path, monkeypatch):
    from evenkeel.operators import hooks
    from evenkeel.sources.results import read_generation_log
    from evenkeel.streaming import generation

    monkeypatch.setattr(generation, "BUCKETS", 2)
    source, log = str(tmp_path / "source"), str(tmp_path / "log")
    large = 2**53 + 1
    rows = [("a", large, "y", 1), ("a", large, "x", 1), ("a", large, "x", 0), ("a", None, "n", None), (None, 1, None, 2), ("b", large, "z", 3)]
    rows += [("c", i, f"t{i}", i) for i in range(40)]
    spark.createDataFrame(rows, generation.SAMPLE_SCHEMA).repartition(5).write.parquet(source)
    echo = hooks.expression_generator(lambda df: F.col("text"))
    for files in (5, 2):  # at once, then under a lost checkpoint: nothing twice
        generation.generate_stream(spark, source, echo, log, str(tmp_path / f"checkpoint-{files}"), files_per_batch=files)
        found = {(r.dataset_id, r.src_id, r.text, r.label) for r in read_generation_log(spark, log).collect()}
        assert found == set(rows) - {("a", large, "y", 1), ("a", large, "x", 1)}
        assert read_generation_log(spark, log).count() == len(found)
