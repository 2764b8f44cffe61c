"""Vectors in files, and how little greedy matching over them shuffles and writes."""

import os

import numpy as np
import pytest

from evenkeel.operators import matching, quality, vector_files
from evenkeel.workspace import new_path

PAIR = ["dataset_id", "src_id", "pass"]
WORDS = [f"w{i}" for i in range(400)]


def written(spark):
    top = os.path.dirname(new_path(spark, "x")).removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(w, rng.normal(size=4).tolist()) for w in WORDS], "token string, vector array<float>")


@pytest.fixture(scope="module")
def long_pairs(spark, tmp_path_factory):
    """1,200 pairs of about 100 words in as many files as there are cores; their texts share half of the words."""
    rng, path = np.random.default_rng(5), str(tmp_path_factory.mktemp("pairs") / "pairs")
    rows = []
    for i in range(600):
        original = rng.choice(WORDS, 100)
        rows += [(f"d{i % 2}", i, no, " ".join([*original[:50], *rng.choice(WORDS, 50)]), " ".join(original)) for no in (0, 1)]
    df = spark.createDataFrame(rows, "dataset_id string, src_id long, pass int, paraphrase string, original string")
    df.repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("part_keys", [250_000, 50])
@pytest.mark.parametrize("mapped", [True, False])
def test_vectors_are_found_by_key_and_read_in_place(spark, monkeypatch, part_keys, mapped):
    monkeypatch.setattr(vector_files, "PART_KEYS", part_keys)
    given = {w: [float(i), i + 0.5] for i, w in enumerate([*WORDS, "", "é"])}
    rows = [*given.items(), ("none", None), (None, [1.0, 2.0])]
    places, folder = vector_files.write_vectors(spark.createDataFrame(rows, "token string, vector array<float>").repartition(3))
    files = vector_files.write_index(places, places.count(), folder, 2)
    assert len(files.index) == (1 if part_keys > 1000 else 9)
    if not mapped:
        from pyarrow import fs

        monkeypatch.setattr(vector_files, "file_system", lambda path: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), path.removeprefix("file:").lstrip("/")))
        monkeypatch.setattr(vector_files, "NEAR_BYTES", 16)
    asked = ["w399", "none", "w7", "unknown", "é", "", *WORDS[50:90:3]]
    found, values = files.read(asked)
    assert {asked[i]: v.tolist() for i, v in zip(found, values)} == {t: given[t] for t in asked if t in given}
    assert files.read([])[1].shape == (0, 2)


def test_keys_with_equal_halves_are_told_apart(spark, monkeypatch):
    def crowded(tokens):
        return np.array([[7, int(t[1:])] for t in tokens], np.uint64).reshape(-1, 2)

    monkeypatch.setattr(vector_files, "keys_of", crowded)
    places, folder = vector_files.write_vectors(spark.createDataFrame([(f"w{i}", [float(i)]) for i in (5, 1, 9)], "token string, vector array<float>"))
    found, values = vector_files.write_index(places, 3, folder, 1).read(["w9", "w4", "w1", "w5", "w10"])
    assert dict(zip(found.tolist(), values[:, 0].tolist())) == {0: 9.0, 2: 1.0, 3: 5.0}


def test_vectors_of_unlike_lengths_are_refused(spark):
    with pytest.raises(ValueError, match="vectors of 1 and of 2 numbers"):
        matching.matcher(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "token string, vector array<float>"))


def test_matching_of_many_tokens_shuffles_nothing(spark, table, long_pairs):
    plan = matching.greedy_match_f1(long_pairs, table, PAIR, max_rows=3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_matching_of_many_tokens_writes_vectors_and_scores_only(spark, table, long_pairs):
    whole = {tuple(r[:3]): r.score for r in matching.greedy_match_f1(long_pairs, table, PAIR, keep=PAIR).collect()}
    before = written(spark)
    scored = matching.greedy_match_f1(long_pairs, table, PAIR, max_rows=3, keep=PAIR)
    assert written(spark) - before < 80_000  # 751,934 with the codes of the pairs
    assert {tuple(r[:3]): r.score for r in scored.collect()} == pytest.approx(whole, abs=1e-6) and len(whole) == 1200


def test_acceptance_of_many_tokens_writes_vectors_and_scores_only(spark, table, long_pairs):
    before = written(spark)
    scored = matching.greedy_match_f1(long_pairs, table, PAIR, max_rows=3, keep=["dataset_id", "pass"])
    out = quality.acceptance_per_pass(scored, threshold=0.0).collect()
    assert written(spark) - before < 80_000  # 744,767 with the codes of the pairs
    assert sorted((r.dataset_id, r["pass"], r.n_total, r.n_accepted) for r in out) == [(d, no, 300, 300) for d in ("d0", "d1") for no in (0, 1)]


def test_quality_of_many_tokens_writes_no_texts(spark, table, long_pairs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    size = spark.conf.get(name)
    few = quality.pass_quality(matching.greedy_match_f1(long_pairs, table, PAIR), PAIR, threshold=0.0)
    before = written(spark)
    many = quality.pass_quality(matching.greedy_match_f1(long_pairs, table, PAIR, max_rows=3), PAIR, threshold=0.0)
    assert written(spark) - before < 160_000  # 1,406,564 with texts and codes
    assert spark.conf.get(name) == size

    def rows(df):
        return sorted((r.dataset_id, r["pass"], r.n_total, r.n_accepted, round(r.mean_score, 6), round(r.bleu, 6)) for r in df.collect())

    assert rows(many) == rows(few) and len(rows(many)) == 4
