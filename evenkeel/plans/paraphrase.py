"""Balancing with generated paraphrases: up to 15 passes over the minority rows of all datasets at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.constants import MAX_PASSES, SCORE_THRESHOLD
from evenkeel.operators.hooks import Generator
from evenkeel.operators.joining import attach_settled, orphans, pair_by_id, pending
from evenkeel.operators.profile import balance_need
from evenkeel.operators.quality import keep_valid
from evenkeel.operators.ranking import CELL_ROWS, first_n
from evenkeel.sinks.tables import append_generated
from evenkeel.sources.results import read_generation_log
from evenkeel.workspace import measure, new_path, settle, within_bounds

KEYS = ["dataset_id", "src_id"]
Scorer = Callable[..., DataFrame]


def run_passes(
    minority: DataFrame,
    plan: DataFrame,
    generate: Generator,
    score: Scorer,
    log_path: str,
    passes: tuple[int, int],
    threshold: float = SCORE_THRESHOLD,
    slices: int = 1,
    fits: bool | None = None,
) -> DataFrame:
    """Generate what the log lacks for the planned passes, then judge everything logged for them: the accepted rows, settled.

    ``plan`` has the first and last pass of every open dataset, ``passes`` the first and last of all. The cheap filter
    comes before the scorer. With ``slices`` the pending rows are logged in that many appends; an interruption
    loses no more than one of them.
    """
    spark, by = minority.sparkSession, ["dataset_id"]
    open_rows = attach_settled(minority, plan, by, fits=fits)
    samples = open_rows.withColumn("pass", F.explode(F.sequence("first", "last"))).select(*minority.columns, "pass")

    def logged() -> DataFrame:
        return read_generation_log(spark, log_path).where(F.col("pass").between(*passes))

    for number in range(slices):
        todo = pending(samples, logged(), [*KEYS, "pass"])
        if slices > 1:
            todo = todo.where(F.pmod(F.xxhash64(*KEYS, "pass"), F.lit(slices)) == number)
        append_generated(generate(todo), log_path)
    planned = attach_settled(logged(), plan, by, fits=fits).where(F.col("pass").between(F.col("first"), F.col("last")))
    valid = keep_valid(pair_by_id(planned.drop("first", "last"), minority))
    accepted = score(valid, [*KEYS, "pass"]).where(F.col("score") >= threshold)
    return settle(accepted.select(*KEYS, "pass", F.col("paraphrase").alias("text"), "label"), "accepted")


def paraphrase_balance(
    df: DataFrame,
    generate: Generator,
    score: Scorer,
    log_path: str | None = None,
    threshold: float = SCORE_THRESHOLD,
    max_passes: int = MAX_PASSES,
    slices: int = 1,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """All rows of ``df`` (dataset_id, row_id, text, label) plus the accepted paraphrases that are needed.

    ``pass`` is null for original rows; ``row_id`` of a paraphrase is its source row, so (dataset_id, row_id, pass) is
    unique. Passes are taken in order, and within a pass the rows in source order. A pass accepts at most one
    paraphrase of each minority row, so a dataset that lacks several times its minority's rows needs as many passes
    for certain: these run as one job, for all datasets together, and the loop goes on with what is still lacking.
    Every round is written down before it is used, so plans stay short, and the driver only learns whether a dataset
    still lacks rows. With the same ``log_path`` an interrupted run goes on where it stopped.
    """
    spark = df.sparkSession
    log_path = log_path or new_path(spark, "generated")
    need = settle(balance_need(df).where(F.col("needed") > 0), "need")
    remaining = need.select(
        "dataset_id", F.col("needed").alias("remaining"), "minority_count", F.lit(0).alias("first")
    )
    rare = attach_settled(
        df.select("dataset_id", F.col("row_id").alias("src_id"), "text", "label"),
        need.select("dataset_id", "minority_label"),
        ["dataset_id"],
    )
    # The one copy of the minority's texts that all passes read.
    minority = settle(
        rare.where(F.col("label") == F.col("minority_label")).drop("minority_label"), "minority"
    )
    strangers = orphans(read_generation_log(spark, log_path), minority)
    if not strangers.join(need.select("dataset_id"), "dataset_id", "left_semi").isEmpty():
        raise ValueError("the log holds paraphrases of unknown rows")

    accepted, quotas = [], []
    by_pass = Window.partitionBy("dataset_id").orderBy("pass")  # at most ``max_passes`` rows a dataset
    while True:
        certain = F.expr("(remaining + minority_count - 1) div minority_count").cast("int")
        last = F.least(F.lit(max_passes), F.col("first") + certain) - 1
        plan = settle(remaining.where(F.col("first") < max_passes).withColumn("last", last), "passes")
        n_open, size, begin, end = measure(plan, F.min("first"), F.max("last"))
        if not n_open:
            break
        fits, span = within_bounds(n_open, size), plan.select("dataset_id", "first", "last")
        rows = run_passes(minority, span, generate, score, log_path, (begin, end), threshold, slices, fits)
        accepted.append(rows)
        counts = rows.groupBy("dataset_id", "pass").agg(F.count(F.lit(1)).alias("n"))
        passes = plan.withColumn("pass", F.explode(F.sequence("first", "last"))).join(counts, ["dataset_id", "pass"], "left")
        passes = passes.withColumn("n", F.coalesce("n", F.lit(0)))
        passes = settle(passes.withColumn("upto", F.sum("n").over(by_pass)), "passes")
        quotas.append(passes.select("dataset_id", "pass", (F.col("remaining") - F.col("upto") + F.col("n")).alias("k")))
        final = passes.where(F.col("pass") == F.col("last"))
        remaining = final.select(
            "dataset_id",
            (F.col("remaining") - F.col("upto")).alias("remaining"),
            "minority_count",
            (F.col("last") + 1).alias("first"),
        ).where(F.col("remaining") > 0)

    originals = df.select("dataset_id", "row_id", "text", "label", F.lit(None).cast("int").alias("pass"))
    if not accepted:
        return originals
    source = F.col("src_id")
    synthetic = first_n(
        reduce(DataFrame.unionByName, accepted),
        ["dataset_id", "pass"],
        source,
        source,
        reduce(DataFrame.unionByName, quotas),
        cell_rows,
    )
    return originals.unionByName(synthetic.select("dataset_id", source.alias("row_id"), "text", "label", "pass"))
