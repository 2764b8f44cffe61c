"""The registered queries: plans, contracts and a model run."""

import ast
import os
import re

import duckdb
import pytest

import __spark_entry__ as driver
from evenkeel.operators import bleu, metrics, ranking, splits
from evenkeel.plans import tables as t
from evenkeel.plans.registry import QUERIES, SQL
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PACKAGE = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "evenkeel")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_check_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["train_test_split", "duplicate_minority", "macro_f1", "valid_paraphrase"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = driver.queries()[name](spark, SF)
    cursor = con.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    theirs = sorted(map(str, cursor.fetchall()))
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == theirs


def test_split_never_shuffles_the_texts(spark):
    df = t.event_examples(spark, SF).withColumn("dataset_id", F.col("text"))
    final = plan(splits.train_test_split(df))
    assert "hashpartitioning" not in final and "BroadcastHashJoin" in final


def test_bleu_shuffles_counts_only(spark):
    df = spark.createDataFrame([("d", 0, 1, "a", "b")], "dataset_id string, pass int, src_id long, paraphrase string, original string")
    assert "Exchange" not in plan(bleu.ngram_counts(df, ["dataset_id", "pass"]))
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan(bleu.corpus_bleu(df, ["dataset_id", "pass"])))
    assert len(exchanges) == 1


def test_metrics_scan_the_predictions_once(spark):
    text = plan(metrics.fairness_report(t.predictions(spark, SF)))
    assert text.count("FileScan parquet") == 2  # documents and labels
    assert re.search(r"PushedFilters: \[IsNotNull\(doc_id\)\]", text)
    assert "text#" not in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(t.examples(spark, SF).groupBy("dataset_id", "label").count())
    assert "struct<doc_id:bigint,lang:string>" in text and "struct<doc_id:bigint,quality:int>" in text


def test_no_window_without_partitions(spark):
    rows = t.event_examples(spark, SF)
    text = plan(ranking.row_positions(rows, ["dataset_id"], ["row_id"]))
    assert "Window" not in text or "hashpartitioning" in text
    assert "SinglePartition" not in text


def test_sources_keep_to_the_rules():
    """No local checkpoints, cross joins, sampling or row-at-a-time UDFs anywhere in the package."""
    banned = {"localCheckpoint", "crossJoin", "sample", "randomSplit", "udf", "rdd", "zipWithIndex"}
    for folder, _, files in os.walk(PACKAGE):
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    tree = ast.parse(f.read())
                used = {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
                assert not used & banned, (name, used & banned)


def test_worker_functions_travel_with_the_job(tmp_path):
    import subprocess
    import sys

    from evenkeel.operators.near_miss import selected_distances
    from pyspark import cloudpickle

    (tmp_path / "fn").write_bytes(cloudpickle.dumps(selected_distances))
    code = "import pickle, numpy as np; print(pickle.load(open('fn', 'rb'))(np.eye(2), np.eye(2), 1, False).sum())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "0.0", out.stderr
