import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import bleu, hooks, joining, matching, quality
from evenkeel.plans.paraphrase import paraphrase_balance
from evenkeel.plans.quality import report_on_log
from evenkeel.sinks.tables import append_generated
from evenkeel.sources.results import read_generation_log
from evenkeel.streaming.generation import generate_stream

PAIR = ["dataset_id", "pass", "src_id"]
PAIR_SCHEMA = "dataset_id string, pass int, src_id long, paraphrase string, original string"


def pairs(spark, rows):
    return spark.createDataFrame([("d", 0, i, p, o) for i, (p, o) in enumerate(rows)], PAIR_SCHEMA)


def bleu_of(spark, rows):
    return bleu.corpus_bleu(pairs(spark, rows), ["dataset_id"], PAIR).first().bleu


def brute_bleu(rows):
    matches, possible = [0] * 4, [0] * 4
    for p, o in rows:
        ours, theirs = p.split(), o.split()
        for n in range(1, 5):
            a = Counter(tuple(ours[i : i + n]) for i in range(len(ours) - n + 1))
            b = Counter(tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1))
            matches[n - 1] += sum((a & b).values())
            possible[n - 1] += sum(a.values())
    if not min(matches):
        return 0.0
    ours, theirs = (sum(len(r[k].split()) for r in rows) for k in (0, 1))
    brevity = 1.0 if ours > theirs else math.exp(1 - theirs / ours)
    return 100 * brevity * math.exp(sum(math.log(m / p) for m, p in zip(matches, possible)) / 4)


def test_bleu_edges(spark):
    assert bleu_of(spark, [("a b c d e", "a b c d e")]) == pytest.approx(100)
    assert bleu_of(spark, [("a b c", "a b c")]) == 0.0
    assert bleu_of(spark, [("x y z w", "a b c d")]) == 0.0
    assert bleu_of(spark, [("", "a b c d")]) == 0.0
    assert bleu_of(spark, [("", ""), ("", "a")]) == 0.0
    assert 0 < bleu_of(spark, [("a b c d", "a b c d e f")]) == pytest.approx(100 * math.exp(1 - 6 / 4))


def test_bleu_clips_within_each_pair(spark):
    rng = np.random.default_rng(3)
    rows = [
        (" ".join(rng.choice(list("abc"), rng.integers(0, 30))), " ".join(rng.choice(list("abcd"), rng.integers(0, 30))))
        for _ in range(25)
    ]
    assert bleu_of(spark, rows) == pytest.approx(brute_bleu(rows))


WORDS = [f"w{i}" for i in range(30)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    return {w: rng.normal(size=8).tolist() for w in WORDS[:25]}


def brute_match(p, o, vectors):
    def cosine(a, b):
        if a == b:
            return 1.0
        if a not in vectors or b not in vectors:
            return 0.0
        x, y = np.array(vectors[a]), np.array(vectors[b])
        return max(0.0, float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)))

    ours, theirs = p.lower().split(), o.lower().split()
    if not ours or not theirs:
        return 0.0
    precision = np.mean([max(cosine(a, b) for b in theirs) for a in ours])
    recall = np.mean([max(cosine(a, b) for b in ours) for a in theirs])
    return 0.0 if precision + recall == 0 else 2 * precision * recall / (precision + recall)


@pytest.mark.parametrize("max_rows", [matching.VECTOR_ROWS, 3])
def test_greedy_match_both_ways(spark, vectors, max_rows):
    rng = np.random.default_rng(9)
    rows = [(" ".join(rng.choice(WORDS, rng.integers(0, 12))), " ".join(rng.choice(WORDS, rng.integers(0, 12)))) for _ in range(20)]
    rows += [("", ""), ("w1 W1 w2", "w1"), ("w28", "w29"), ("w3 w28", "w4 w28 w28")]
    table = spark.createDataFrame(list(vectors.items()), "token string, vector array<float>")
    out = matching.greedy_match_f1(pairs(spark, rows), table, PAIR, max_rows=max_rows)
    scores = [r.score for r in out.orderBy("src_id").collect()]
    assert scores == pytest.approx([brute_match(p, o, vectors) for p, o in rows], abs=1e-6)


def test_passes_with_fewer_than_two_accepted_are_left_out(spark):
    rows = [("d", 0, 0.85), ("d", 0, 0.9), ("d", 0, 0.1), ("d", 1, 0.9), ("d", 1, 0.2), ("d", 2, 0.9), ("e", 0, 0.95), ("e", 0, 0.85)]
    scored = spark.createDataFrame(rows, "dataset_id string, pass int, score double")
    out = {(r.dataset_id, r["pass"]): r for r in quality.acceptance_per_pass(scored).collect()}
    assert set(out) == {("d", 0), ("e", 0)}
    assert (out[("d", 0)].n_total, out[("d", 0)].n_accepted) == (3, 2)
    assert out[("d", 0)].mean_score == pytest.approx(0.875)


def test_report_uses_the_population_deviation(spark):
    rows = [("d", 0, 0.5, 0.9, 20.0), ("d", 1, 1.0, 0.94, 30.0)]
    per_pass = spark.createDataFrame(rows, "dataset_id string, pass int, acceptance_rate double, mean_score double, bleu double")
    row = quality.quality_report(per_pass).first()
    assert tuple(row) == ("d", 2, 0.75, 0.92, 0.02, 25.0, 5.0)


# ---- The loop -------------------------------------------------------------------------------------------

TEXT = "one1 two2 three3 four4 five5 six6 seven7 eight8"


def corpus(spark, sizes):
    rows = [
        (d, i, f"{TEXT} {d}{i}", int(i >= few)) for d, (few, many) in sizes.items() for i in range(few + many)
    ]
    return spark.createDataFrame(rows, "dataset_id string, row_id long, text string, label int")


def always(value):
    return lambda pairs, ids: pairs.withColumn("score", F.lit(value))


echo = hooks.expression_generator(lambda df: F.col("text"))


def by_class(df):
    return {(r.dataset_id, r.label): r["count"] for r in df.groupBy("dataset_id", "label").count().collect()}


def test_echo_reaches_balance_exactly(spark):
    df = corpus(spark, {"a": (3, 10), "b": (4, 4), "c": (2, 5)})
    out = paraphrase_balance(df, echo, always(0.85)).cache()
    assert by_class(out) == {("a", 0): 10, ("a", 1): 10, ("b", 0): 4, ("b", 1): 4, ("c", 0): 5, ("c", 1): 5}
    last = out.where("dataset_id = 'a' and pass = 2").collect()
    assert [r.row_id for r in last] == [0]  # 7 rows are lacking: two whole passes of 3 and one row


def test_useless_generator_stops_after_all_passes(spark, tmp_path):
    df = corpus(spark, {"a": (2, 6)})
    log = str(tmp_path / "log")
    silent = hooks.expression_generator(lambda df: F.lit(""))
    out = paraphrase_balance(df, silent, always(1.0), log, max_passes=3)
    assert by_class(out) == {("a", 0): 2, ("a", 1): 6}
    assert [r["pass"] for r in read_generation_log(spark, log).select("pass").distinct().orderBy("pass").collect()] == [0, 1, 2]


def test_low_scores_are_dropped_and_the_cap_follows_source_order(spark):
    df = corpus(spark, {"a": (4, 9)})
    score = lambda pairs, ids: pairs.withColumn("score", F.when(F.col("src_id") == 1, 0.84).otherwise(0.9))
    out = paraphrase_balance(df, echo, score).where("pass is not null")
    assert sorted((r["pass"], r.row_id) for r in out.collect()) == [(0, 0), (0, 2), (0, 3), (1, 0), (1, 2)]


def test_interrupted_loop_resumes_from_its_log(spark, tmp_path):
    df = corpus(spark, {"a": (3, 10)})
    log = str(tmp_path / "log")
    done = df.where("row_id = 1").select(
        "dataset_id", F.col("row_id").alias("src_id"), F.concat("text", F.lit(" logged")).alias("text"), "label", F.lit(0).alias("pass")
    )
    append_generated(done, log)
    out = paraphrase_balance(df, echo, always(1.0), log, slices=2).where("pass is not null").cache()
    assert out.count() == 7
    assert out.where("pass = 0 and text like '% logged'").count() == 1
    n_logged = read_generation_log(spark, log).count()
    again = paraphrase_balance(df, echo, always(1.0), log).where("pass is not null")
    assert again.exceptAll(out).isEmpty() and read_generation_log(spark, log).count() == n_logged == 9


def test_unknown_row_in_the_log_is_an_error(spark, tmp_path):
    df = corpus(spark, {"a": (3, 10)})
    log = str(tmp_path / "log")
    stranger = spark.createDataFrame([("a", 99, "x", 0, 0)], "dataset_id string, src_id long, text string, label int, pass int")
    append_generated(stranger, log)
    with pytest.raises(ValueError, match="unknown rows"):
        paraphrase_balance(df, echo, always(1.0), log)


def test_batch_generator_loads_its_model_once_per_task(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda prompts, passes: [p.split('"')[1].upper() + "<turn|> rest" for p in prompts]

    samples = corpus(spark, {"a": (2, 2)}).select("dataset_id", F.col("row_id").alias("src_id"), "text", "label", F.lit(0).alias("pass"))
    out = hooks.batch_generator(load)(samples.coalesce(1)).collect()
    assert sorted(r.text for r in out) == sorted(f"{TEXT} a{i}".upper() for i in range(4))
    assert loads.value == 1


def test_pair_scorer_hook(spark):
    score = hooks.pair_scorer(lambda ours, theirs: [float(a == b) for a, b in zip(ours, theirs)])
    df = score(pairs(spark, [("a", "a"), ("a", "b")]), ["src_id"])
    assert [r.score for r in df.orderBy("src_id").collect()] == [1.0, 0.0]


def test_stream_is_resumable(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ("source", "log", "checkpoint"))
    samples = corpus(spark, {"a": (5, 5), "b": (5, 5)}).select("dataset_id", F.col("row_id").alias("src_id"), "text", "label")
    samples.repartition(4).write.parquet(source)
    append_generated(samples.where("src_id < 3").withColumn("pass", F.lit(0)).withColumn("text", F.lit("kept")), log)
    generate_stream(spark, source, echo, log, checkpoint)
    logged = read_generation_log(spark, log)
    assert logged.count() == logged.select("dataset_id", "src_id").distinct().count() == 20
    assert logged.where("text = 'kept'").count() == 6
    generate_stream(spark, source, echo, log, checkpoint)
    generate_stream(spark, source, echo, log, str(tmp_path / "lost checkpoint"))
    assert read_generation_log(spark, log).count() == 20


def test_stream_batches_read_no_log_and_replace_their_folder(spark, tmp_path):
    import os
    import shutil

    source, log, checkpoint = (str(tmp_path / n) for n in ("source", "log", "checkpoint"))
    samples = corpus(spark, {"a": (6, 6)}).select("dataset_id", F.col("row_id").alias("src_id"), "text", "label")
    samples.repartition(3).write.parquet(source)
    seen = []

    def watched(batch):
        seen.append(batch._jdf.queryExecution().toString())
        return echo(batch)

    generate_stream(spark, source, watched, log, checkpoint)
    folders = sorted(f for f in os.listdir(f"{log}/pass=0") if f.startswith("stream-"))
    assert len(folders) == len(seen) >= 3 and not any(log in plan for plan in seen)
    before = sorted(map(tuple, read_generation_log(spark, log).collect()))
    # The last batch is run again, as after an interruption between its write and its commit; duplicates come with it.
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    os.rename(f"{checkpoint}/commits/{last}", str(tmp_path / "commit"))
    crc = f"{checkpoint}/commits/.{last}.crc"
    if os.path.exists(crc):
        os.rename(crc, str(tmp_path / "crc"))
    samples.where("src_id < 3").withColumn("text", F.lit("again")).write.mode("append").parquet(source)
    # Rows that an earlier run of the batch left behind are replaced.
    kept = f"{log}/pass=0/{folders[-1]}"
    for name in os.listdir(kept):
        if name.endswith(".parquet"):
            shutil.copy(f"{kept}/{name}", f"{kept}/copy-{name}")
    generate_stream(spark, source, echo, log, checkpoint)
    assert sorted(map(tuple, read_generation_log(spark, log).collect())) == before


def test_report_on_log(spark):
    df = corpus(spark, {"a": (3, 0)}).select("dataset_id", F.col("row_id").alias("src_id"), "text", "label")
    log = df.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    row = report_on_log(log, df, always(0.9)).first()
    assert (row.n_passes, row.acceptance_rate, row.score_mean, row.bleu_mean) == (2, 1.0, 0.9, 100.0)
    assert joining.orphans(log, df.where("src_id > 0")).count() == 2


def test_pairs_by_position_are_cut_to_the_shorter_side(spark):
    schema = "dataset_id string, row_id long, text string"
    ours = spark.createDataFrame([("d", 5, "a"), ("d", 9, "b"), ("e", 1, "c")], schema)
    theirs = spark.createDataFrame([("d", 1, "A"), ("d", 2, "B"), ("d", 3, "C"), ("f", 1, "X")], schema)
    out = quality.pair_by_position(ours, theirs).collect()
    assert sorted((r.paraphrase, r.original, r.position) for r in out) == [("a", "A", 0), ("b", "B", 1)]


def test_bleu_tokens_are_those_of_the_columns(spark):
    from evenkeel.functions.text import bleu_tokens, joined_tokens, ws_tokens

    texts = ["It's 3.5, or 4-5 &lt;b&gt; (x).", "a b c\x1cd \t e", "<skipped>one-\ntwo\nthree", "", "...", "1,000.00 is 5% &amp;amp; more", " end. "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(bleu_tokens(F.col("t")), joined_tokens(F.col("t")), ws_tokens(F.col("t"))).collect()
    codes = bleu.Tokenizer()
    for text, (expected, joined, tokens) in zip(texts, rows):
        ours = codes(text).tolist()
        names = {n: w for w, n in codes.numbers.items()}
        assert [names[c] for c in ours] == expected
        assert joined == " ".join(tokens)


def test_no_vector_per_pair_and_token_in_a_shuffle(spark, vectors):
    table = spark.createDataFrame(list(vectors.items()), "token string, vector array<float>")
    rows = [("w1 w2", f"w3 w4 w{i % 5}") for i in range(50)]
    scored = matching.greedy_match_f1(pairs(spark, rows), table, PAIR, max_rows=3)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Exchange hashpartitioning(_batch" in line]
    assert len(sent) == 1 and "collect_list" not in plan


def test_passes_are_paired_by_position_one_by_one(spark):
    ours = spark.createDataFrame(
        [("d", 0, 4, "a"), ("d", 0, 9, "b"), ("d", 1, 2, "c"), ("d", 1, 3, "e"), ("d", 1, 8, "f"), ("x", 0, 1, "g")],
        "dataset_id string, pass int, row_id long, text string",
    )
    theirs = spark.createDataFrame([("d", 7, "A"), ("d", 5, "B")], "dataset_id string, row_id long, text string")
    out = quality.pair_by_position(ours, theirs, within=["pass"]).collect()
    assert sorted((r["pass"], r.row_id, r.paraphrase, r.original) for r in out) == [(0, 4, "a", "B"), (0, 9, "b", "A"), (1, 2, "c", "B"), (1, 3, "e", "A")]
