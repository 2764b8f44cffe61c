import gzip
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import encoding, near_miss, reshape, upsert
from evenkeel.plans.comparison import strategy_comparison, timed_comparison
from evenkeel.plans.ingest import ingest_reviews, profile_into
from evenkeel.plans.training import run_records
from evenkeel.sinks.tables import materialise, write_dataset, write_report
from evenkeel.sources import results, reviews


def test_reviews(spark, tmp_path):
    path = tmp_path / "reviews.json.gz"
    lines = [
        {"overall": 5.0, "reviewText": "good", "other": 1},
        {"overall": 3.0, "reviewText": "so so"},
        {"overall": 2.0, "reviewText": "  "},
        {"overall": 1.0},
        {"reviewText": "no rating"},
        {"overall": 2.5, "reviewText": "hm"},
    ]
    with gzip.open(path, "wt") as f:
        f.writelines(json.dumps(line) + "\n" for line in lines)
    raw = reviews.read_reviews_json(spark, str(path), partitions=3)
    assert raw.count() == 6 and raw.where("reviewText = ''").count() == 1
    out = ingest_reviews(spark, str(path), str(tmp_path / "out"))
    assert sorted((r.text, r.label) for r in out.collect()) == [("  ", 0), ("good", 1), ("hm", 1)]
    known = profile_into(out.where("label = 1"), "x/y")
    assert profile_into(out, "x/y", known).first().counts == {"0": 1, "1": 2}


def test_malformed_review_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"overall": 1.0}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        reviews.read_reviews_json(spark, str(tmp_path / "bad.json")).collect()


def test_parallel_text_over_many_blocks(spark, tmp_path):
    texts = [f"line {i}" + " x" * (i % 7) for i in range(2000)]
    (tmp_path / "texts.txt").write_text("\n".join(texts) + "\n")
    (tmp_path / "score.txt").write_text("\n".join("-1" if i % 3 == 0 else "1" for i in range(2000)) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        out = reviews.read_parallel_text(spark, str(tmp_path / "texts.txt"), str(tmp_path / "score.txt"))
        rows = out.orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [r.text for r in rows] == texts
    assert [r.row_id for r in rows] == list(range(2000))
    assert [r.label for r in rows] == [0 if i % 3 == 0 else 1 for i in range(2000)]
    (tmp_path / "short.txt").write_text("1\n")
    with pytest.raises(ValueError, match="2000 texts but 1 scores"):
        reviews.read_parallel_text(spark, str(tmp_path / "texts.txt"), str(tmp_path / "short.txt"))


def test_unicode_line_breaks(spark, tmp_path):
    text = "a b\r\nc\x0cd\ne\x85f\x1cg\n"
    (tmp_path / "t.txt").write_bytes(text.encode())
    out = [r.value for r in reviews.read_lines(spark, str(tmp_path / "t.txt")).orderBy("row_id").collect()]
    assert out == text.splitlines()


def test_pass_log(spark, tmp_path):
    path = tmp_path / "pass_002.jsonl"
    path.write_text('{"id": "p2_orig_7", "text": "t", "label": 0}\n\n{"id": "p2_orig_8", "text": "u", "label": 0}\n')
    out = results.read_pass_log(spark, str(path)).orderBy("src_id").collect()
    assert [tuple(r) for r in out] == [("p2_orig_7", 2, 7, "t", 0), ("p2_orig_8", 2, 8, "u", 0)]
    assert results.read_pass_log(spark, str(tmp_path / "missing.jsonl")).count() == 0
    assert results.read_runs(spark, str(tmp_path / "missing.json")).count() == 0


PUBLISHED = [
    {
        "dataset": "d1",
        "methods": [
            {"method": "baseline", "macro_f1": 0.8, "tpr_gap": 0.3, "speedup": 1, "recall_minority": 0.6},
            {"method": "UBR", "macro_f1": 0.82, "tpr_gap": 0.2, "speedup": 1.5},
            {"method": "baseline", "macro_f1": 0.1, "tpr_gap": 0.1, "speedup": 1},
        ],
    }
]


def test_published_documents(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(PUBLISHED, indent=1))
    docs = results.read_published(spark, str(tmp_path / "p.json"))
    flat = reshape.flatten_methods(docs)
    assert flat.count() == 3 and flat.where("recall_minority is null").count() == 2
    assert [r.method for r in reshape.select_methods(flat, ["UBR", "NM1"]).collect()] == ["UBR"]
    assert tuple(reshape.published_baseline(docs).first()) == ("d1", 0.8, 0.3, 1.0)
    with pytest.raises(Exception, match="no matching element"):
        reshape.published_baseline(docs, "absent").collect()


def test_run_and_metric_documents(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"job_id": "a/b", "success": True, "elapsed_seconds": 2.0}]))
    assert results.read_runs(spark, str(tmp_path / "r.json")).first().job_id == "a/b"
    metrics = {"d1": {"macro_f1": 0.5, "tpr_gap": 0.1}, "d2": {"macro_f1": 0.6}}
    (tmp_path / "m.json").write_text(json.dumps(metrics, indent=1))
    out = {r.dataset_id: r.macro_f1 for r in results.read_metrics(spark, str(tmp_path / "m.json")).collect()}
    assert out == {"d1": 0.5, "d2": 0.6}
    maps = spark.createDataFrame([({"d1": {"macro_f1": 0.5}},)], "metrics map<string, map<string, double>>")
    assert tuple(reshape.metrics_from_map(maps).first()) == ("d1", "macro_f1", 0.5)


def test_files_hold_a_bounded_number_of_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    write_dataset(spark.range(100).coalesce(1), path, rows_per_file=30)
    sizes = spark.read.parquet(path).groupBy(F.col("_metadata.file_name")).count().collect()
    assert sorted(r["count"] for r in sizes) == [10, 30, 30, 30]
    write_report(spark.range(2), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_materialise_skips_what_is_there(spark, tmp_path):
    root = str(tmp_path / "data")
    rows = [("s", "a/b", "train", 1), ("s", "a/b", "test", 2), ("s", "a/c", "train", 3)]
    schema = "strategy string, dataset_id string, split string, x int"
    materialise(spark.createDataFrame(rows[:2], schema), root)
    materialise(spark.createDataFrame([(s, d, p, x + 10) for s, d, p, x in rows], schema), root)
    out = spark.read.parquet(root).select("dataset_id", "split", "x").collect()
    assert sorted(tuple(r) for r in out) == [("a/b", "test", 2), ("a/b", "train", 1), ("a/c", "train", 13)]


def test_run_log_precedence(spark):
    old = spark.createDataFrame([("a", True), ("b", True), ("c", True)], "job_id string, success boolean")
    new = spark.createDataFrame(
        [("a", True, True), ("b", False, False), ("d", True, False)], "job_id string, success boolean, skipped boolean"
    )
    out = upsert.upsert_runs(old, new).collect()
    assert [tuple(r) for r in out] == [("a", True), ("b", False), ("c", True), ("d", True)]


def test_run_records_fit_the_log(spark, tmp_path):
    log = results.read_runs(spark, str(tmp_path / "none.json"))
    schema = "job_id string, success boolean, skipped boolean, elapsed_seconds double, error string"
    jobs = spark.createDataFrame([("a/b", True, False, 1.26, None), ("a/c", True, True, 0.1, None)], schema)
    out = upsert.upsert_runs(log, run_records(jobs, "baseline", "model", 20, 5)).collect()
    assert [tuple(r) for r in out] == [("a/b", "baseline", "model", 20, 5, True, 1.3, "measured", None)]


def test_failed_evaluation_keeps_the_old_metrics(spark):
    old = spark.createDataFrame([("x/a", 0.5), ("y/a", 0.6)], "dataset_id string, macro_f1 double")
    new = spark.createDataFrame(
        [("x/a", None, False), ("y/a", 0.9, True)], "dataset_id string, macro_f1 double, success boolean"
    )
    assert sorted(tuple(r) for r in upsert.upsert_metrics(old, new).collect()) == [("x/a", 0.5), ("y/a", 0.9)]


def test_lookup_falls_back_in_order(spark):
    first = spark.createDataFrame([("a", 1)], "k string, v int")
    second = spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    wanted = spark.createDataFrame([("a",), ("b",)], "k string")
    out = upsert.lookup_with_fallback(wanted, [first, second], ["k"])
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0, 1), ("b", 1, 3)]
    missing = spark.createDataFrame([("z",)], "k string")
    with pytest.raises(Exception, match="not found in any source"):
        upsert.lookup_with_fallback(missing, [first, second], ["k"]).collect()


def test_comparison_is_a_full_outer_join(spark):
    rows = [("a", "s1", 0.12345, 0.1), ("b", "s2", 0.5, 0.2), ("a", "s2", 0.7, 0.3)]
    metrics = spark.createDataFrame(rows, "dataset_id string, strategy string, macro_f1 double, tpr_gap double")
    joined = strategy_comparison(metrics, ["s1", "s2"])
    pivoted = reshape.strategy_table(metrics, ["s1", "s2"], ["macro_f1", "tpr_gap"])
    expected = {("a", 0.1235, 0.1, 0.7, 0.3), ("b", None, None, 0.5, 0.2)}
    assert {tuple(r) for r in joined.collect()} == {tuple(r) for r in pivoted.collect()} == expected
    third = spark.createDataFrame([("c", "s3", 0.9, 0.0)], metrics.schema)
    three = strategy_comparison(metrics.unionByName(third), ["s1", "s2", "s3"]).collect()
    assert [(r.dataset_id, r.s1__macro_f1, r.s2__macro_f1, r.s3__macro_f1) for r in three] == [
        ("a", 0.1235, 0.7, None), ("b", None, 0.5, None), ("c", None, None, 0.9)
    ]
    runs = spark.createDataFrame(
        [("a", "baseline", 2.0, True, "measured"), ("a", "m", 1.0, True, "measured"), ("b", "m", 1.0, True, "measured")],
        "job_id string, strategy string, elapsed_seconds double, success boolean, elapsed_source string",
    )
    assert [r.dataset_id for r in timed_comparison(joined, runs, "m").collect()] == ["a"]
    assert timed_comparison(joined, runs.where("job_id = 'b'"), "m").count() == 2


def test_encoding(spark):
    rows = [("d", 0, "b a b"), ("d", 1, ""), ("d", 2, "b c d e f g")]
    df = spark.createDataFrame(rows, "dataset_id string, row_id long, text string").withColumn("label", F.lit(1))
    out = {r.row_id: r for r in encoding.encode_fixed(df, max_length=4).collect()}
    assert out[0].input_ids == [2, 3, 2, 0] and out[0].attention_mask == [1, 1, 1, 0]
    assert out[1].input_ids == [0] * 4 and out[1].attention_mask == [0] * 4
    assert out[2].input_ids == [2, 4, 5, 6] and out[2].attention_mask == [1] * 4
    beyond = {r.row_id: r.input_ids for r in encoding.encode_fixed(df, max_length=4, max_rows=1).collect()}
    assert beyond == {i: r.input_ids for i, r in out.items()}
    known = spark.createDataFrame([("b", 9)], "token string, token_id int")
    other = {r.row_id: r.input_ids for r in encoding.encode_fixed(df, 4, vocabulary=known).collect()}
    assert other[0] == [9, encoding.UNKNOWN, 9, 0]
    view = encoding.feature_view(encoding.fixed_length(df.withColumn("ids", F.array(F.lit(5))), "ids", 3))
    assert view.columns == ["input_ids", "attention_mask", "labels"]
    assert encoding.feature_view(df).columns == ["labels"]


@pytest.mark.parametrize("max_rows", [10, 1_000])
def test_encoding_in_two_tiers(spark, max_rows, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words[: rng.choice((3, 12, 40))]) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, "", "w1 " * 500, "w39 " * 500]
    df = spark.createDataFrame([("d", i // 2, x) for i, x in enumerate(texts)], "dataset_id string, row_id long, text string")
    counts = Counter(w for x in texts for w in (x or "").split())
    ids = {w: n + encoding.FIRST_ID for n, (w, _) in enumerate(sorted(counts.items(), key=lambda e: (-e[1], e[0])))}
    plans, write = [], encoding.settle

    def watched(rows, label="table"):
        plans.append(rows._jdf.queryExecution().executedPlan().toString() if label == "rare-tokens" else "")
        return write(rows, label)

    monkeypatch.setattr(encoding, "settle", watched)
    out = encoding.encode_fixed(df, 16, max_rows=max_rows)
    want = [(i // 2, [ids[w] for w in (x or "").split()][:16]) for i, x in enumerate(texts)]
    got = [(r.row_id, r.input_ids[: sum(r.attention_mask)]) for r in out.collect()]
    assert sorted(got) == sorted(want)
    # What is shuffled has been cut into tokens or ids: no exchange lies between a scan of texts and the split.
    scans = 0
    for plan in [*plans, out._jdf.queryExecution().executedPlan().toString()]:
        lines = [line.strip(" :+-*()0123456789") for line in plan.splitlines()]
        for at, line in enumerate(lines):
            if "Scan parquet" in line and "text#" in line.split("]")[0]:
                above = next(x for x in reversed(lines[:at]) if x.startswith(("Generate", "Exchange", "BroadcastExchange")))
                assert above.startswith("Generate")
                scans += 1
    assert scans
    assert any(plans) == (max_rows < len(ids))


@pytest.mark.parametrize("farthest", [False, True])
def test_near_miss_by_pivots_equals_broadcast(spark, farthest, monkeypatch):
    monkeypatch.setattr(near_miss, "ROWS_PER_CELL", 8)
    values = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (F.pmod(F.xxhash64("id", i), F.lit(1000)) / 1000).cast("float"))
    df = spark.range(260).select(
        F.when(F.col("id") < 200, "a").otherwise("b").alias("dataset_id"),
        F.col("id").alias("row_id"),
        values.alias("vector"),
        (F.col("id") % 4 > 0).cast("int").alias("label"),
    )
    whole = near_miss.near_miss(df, farthest)
    assert whole.where("label = 1").count() == whole.where("label = 0").count() == 65
    pieces = near_miss.near_miss(df, farthest, max_rows=0)
    assert pieces.select("row_id").exceptAll(whole.select("row_id")).isEmpty() and pieces.count() == 130
    ours = df.where("label = 1").select("dataset_id", "row_id", "vector")
    theirs = df.where("label = 0").select("dataset_id", "row_id", "vector")
    large = near_miss.distances_by_broadcast(ours, theirs, 3, farthest).withColumnRenamed("mean_distance", "d").cache()
    for max_rows in (40, 5):  # several parts, then also several groups of datasets and cells that are cut
        small = near_miss.distances_by_pivots(ours, theirs, 3, farthest, max_rows)
        gap = small.join(large, ["dataset_id", "row_id"])
        assert gap.count() == 195 and gap.where(F.abs(F.col("d") - F.col("mean_distance")) > 1e-9).isEmpty()
    # The majority is neither copied nor shuffled: only ids and distances are.
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and sum("Exchange hashpartitioning(dataset_id" in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize("farthest", [False, True])
def test_distances_are_taken_in_tiles_of_bounded_size(farthest):
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    points, others = rng.normal(size=(1100, 5)), rng.normal(size=(16_000, 5))
    for count, k in ((2, 3), (2049, 3), (5000, 2100)):  # fewer others than k, one more than a tile, k beyond a tile
        exact = np.sort(near_miss.to_pivots(points[:700], others[:count]))
        exact = exact[:, ::-1][:, :k] if farthest else exact[:, :k]
        found = np.sort(near_miss.selected_distances(points[:700], others[:count], k, farthest))
        assert np.allclose(found[:, ::-1] if farthest else found, exact)
    tracemalloc.start()
    near_miss.selected_distances(points, others, 3, farthest)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # One matrix of all distances would take 140 MB, and several of them were held at once.
    assert peak < 50_000_000


@pytest.mark.parametrize("farthest", [False, True])
def test_cells_out_of_reach_hold_no_partner(farthest):
    import numpy as np

    rng = np.random.default_rng(7)
    others = np.concatenate([rng.normal(c, 0.2, (30, 4)) for c in (0, 3, 9, -6)])
    points, pivots = rng.normal(0, 4, (50, 4)), others[[0, 31, 62, 93]]
    cell, distance = near_miss.nearest_pivot(others, pivots)
    sizes = np.bincount(cell, minlength=4)
    radii = np.array([distance[cell == c].max() for c in range(4)])
    for k in (1, 3, 40, 500):
        reach = near_miss.cells_in_reach(near_miss.to_pivots(points, pivots), sizes, radii, k, farthest)
        exact = near_miss.to_pivots(points, others)
        for i in range(len(points)):
            order = np.argsort(-exact[i] if farthest else exact[i])[:k]
            assert reach[i, np.unique(cell[order])].all()
        assert k > 40 or not reach.all()


def test_names_of_two_authors_are_reported(spark):
    config = spark.createDataFrame([("ann", "one"), ("ann", "two"), ("bob", "two"), ("bob", "three")], "author string, name string")
    rows = spark.createDataFrame([("one", 0.5), ("two", 0.4), ("bob/two", 0.3), ("none", 0.2), ("eve/new", 0.1)], "key string, macro_f1 double")
    known = spark.createDataFrame([("ann/one", 2.0), ("ann/two", 3.0), ("bob/two", 4.0)], "dataset_id string, imbalance_ratio double")
    out = reshape.named_metrics_with_ratio(rows, config, known).collect()
    assert [(r.key, r.resolution, r.imbalance_ratio) for r in out] == [
        ("eve/new", "given", None), ("none", "unknown", None), ("bob/two", "given", 4.0), ("two", "ambiguous", None), ("one", "known", 2.0)
    ]


def test_lines_of_a_folder_are_numbered_in_file_order(spark, tmp_path):
    folder = str(tmp_path / "lines")
    spark.range(300).repartitionByRange(5, "id").sortWithinPartitions("id").select(F.col("id").cast("string").alias("value")).write.text(folder)
    out = reviews.read_lines(spark, folder).collect()
    assert len(out) == 300 and all(str(r.row_id) == r.value for r in out)
