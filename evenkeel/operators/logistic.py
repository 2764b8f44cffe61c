"""Text classifiers per key, fitted by gradient steps with early stopping, and kept as a table.

All keys (a dataset under a strategy) take a step in one job: every row meets its key's weights, the gradients are added up per
(key, slot) with map-side combining, and the same scan gives the validation loss of the weights as they are. A key stops by its own
loss; rows of stopped keys are not read further. The driver learns how many keys are open. Weights are one array per key; they are
broadcast while their measured size allows and else joined with the hot keys apart, so rows of a large key never meet in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.text import joined_tokens
from evenkeel.operators.coded import token_codes
from evenkeel.operators.joining import attach, attach_settled
from evenkeel.operators.metrics import fairness_report
from evenkeel.workspace import fits_broadcast, settle

KEYS = ("dataset_id", "strategy")
SLOTS = 1 << 12
STEPS, PATIENCE, RATE, DECAY = 20, 5, 2.0, 1e-4
#: Cells of the gathered sums that come before the slots: training loss, validation loss.
LOSSES = 2
#: Rows whose words are counted at once.
SLICE_ROWS = 1024


def featurise(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Replace ``text`` by the distinct slots of its words and ``amounts``, the row's vector at those slots.

    A word's slot comes from its hash. The vector of a row's counts per slot has length one; a text without words, or null, has no entries.
    A row is as wide as it has distinct slots, however long its text is. Every distinct word of a slice of rows is hashed once.
    """
    kept = [c for c in rows.columns if c != "text"]
    texts = rows.select(*kept, joined_tokens(F.col("text")).alias("_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                (codes,), tokens = token_codes(part.column("_tokens"))
                places = np.array([int(hashlib.md5(t.encode()).hexdigest()[:15], 16) % slots for t in tokens.to_pylist()], np.int64)
                row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
                kinds, counts = np.unique(row * slots + places[np.concatenate(codes)], return_counts=True)
                own, slot = kinds // slots, kinds % slots
                norms = np.sqrt(np.bincount(own, counts.astype(np.float64) ** 2, len(codes)))
                ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(codes)))]).astype(np.int32)
                vectors = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (slot.astype(np.int32), counts / norms[own])]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *vectors], [*kept, "slots", "amounts"])

    lists = [T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("amounts", T.ArrayType(T.DoubleType()))]
    return texts.mapInArrow(run, T.StructType([*[texts.schema[k] for k in kept], *lists]))


def hash_word(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("long")


def margin(weights: str = "weights") -> Column:
    """Score of a row with its key's weights; the last weight is the constant term."""
    parts = F.zip_with("slots", "amounts", lambda s, x: x * F.get(F.col(weights), s))
    return F.element_at(weights, -1) + F.aggregate(parts, F.lit(0.0), lambda a, p: a + p)


def log_loss(score: Column, label: Column) -> Column:
    return F.log1p(F.exp(-F.abs(score))) + F.greatest(score, F.lit(0.0)) - label * score


def _cells(rows: DataFrame, state: DataFrame, keys: list[str], slots: int, fits: bool) -> DataFrame:
    """Per open key the sums of its rows as one array: both losses, the gradient per slot, the gradient of the constant."""
    met = attach_settled(rows, state.select(*keys, "weights"), keys, fits=fits).withColumn("_score", margin())
    loss, error = log_loss(F.col("_score"), F.col("label")), 1 / (1 + F.exp(-F.col("_score"))) - F.col("label")

    def cell(slot, value):
        return F.struct(slot.cast("int").alias("slot"), value.alias("v"))

    met = met.withColumn("_error", error)
    own = F.concat(
        F.array(cell(F.lit(-2), loss), cell(F.lit(slots), F.col("_error"))),
        F.zip_with("slots", "amounts", lambda s, x: cell(s, F.col("_error") * x)),
    )
    # An empty cell for every slot makes the sorted sums an array without gaps.
    gaps = state.select(*keys, F.explode(F.sequence(F.lit(-LOSSES), F.lit(slots))).alias("slot"), F.lit(0.0).alias("v"))
    given = met.select(*keys, F.explode(F.when(F.col("part") == "val", F.array(cell(F.lit(-1), loss))).otherwise(own)).alias("c")).select(*keys, "c.slot", "c.v")
    sums = given.unionByName(gaps).groupBy(*keys, "slot").agg(F.sum("v").alias("v"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("slot", "v"))), lambda c: c["v"])
    return sums.groupBy(*keys).agg(in_order.alias("cells"))


def fit(
    rows: DataFrame,
    slots: int = SLOTS,
    steps: int = STEPS,
    patience: int = PATIENCE,
    rate: float = RATE,
    decay: float = DECAY,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Models (keys.., weights, steps, best_step, val_loss), one row per key, as a settled table.

    ``rows``: keys.., text, label (0 or 1), part (``val`` for validation rows). Training rows give full gradients of the mean logistic loss
    with weight decay. After each step the validation loss is compared with the best so far; after ``patience`` steps without a
    better one the key stops, and the weights of its best step are the model's. A key without validation rows goes by its training loss.
    Rows without a label are left out.
    """
    keys = list(keys)
    labelled = rows.where("label is not null").select(*keys, "text", F.col("label").cast("double").alias("label"), "part")
    given = settle(featurise(labelled, slots), "features")
    is_val = F.coalesce(F.col("part") == "val", F.lit(False))
    given = given.withColumn("part", F.when(is_val, "val").otherwise("train"))
    start = F.array_repeat(F.lit(0.0), slots + 1)
    state = given.groupBy(*keys).agg(F.count(F.when(F.col("part") == "train", 1)).alias("n"), F.count(F.when(F.col("part") == "val", 1)).alias("n_val"))
    state = state.select(
        *keys,
        "n",
        "n_val",
        start.alias("weights"),
        start.alias("best"),
        F.lit(float("inf")).alias("val_loss"),
        F.lit(0).alias("best_step"),
        F.lit(0).alias("steps"),
        F.lit(True).alias("open"),
    )
    state = settle(state, "models")
    fits = fits_broadcast(state)
    for step in range(steps + 1):
        going = state.where("open")
        cells = _cells(given, going, keys, slots, fits)
        state = settle(_advance(state, cells, keys, step, steps, patience, rate, decay), "models")
        if not state.where("open").limit(1).count():
            break
    return settle(state.select(*keys, F.col("best").alias("weights"), "steps", "best_step", "val_loss"), "models")


def _advance(state: DataFrame, cells: DataFrame, keys: list[str], step: int, steps: int, patience: int, rate: float, decay: float) -> DataFrame:
    """Judge the weights after ``step`` steps and, unless the key stops there, take the next step."""
    rows = F.greatest("n", F.lit(1))
    loss = F.when(F.col("n_val") > 0, F.get("cells", F.lit(1)) / F.col("n_val")).otherwise(F.get("cells", F.lit(0)) / rows)
    better = (loss < F.col("val_loss")) if step else F.lit(False)
    slopes = F.slice("cells", LOSSES + 1, F.size("weights"))
    # The constant term, which is last, does not decay.
    moved = F.zip_with("weights", slopes, lambda w, g: w - rate * g / rows)
    moved = F.transform(moved, lambda m, i: F.when(i < F.size("weights") - 1, m - rate * decay * F.get("weights", i)).otherwise(m))
    judged = state.join(cells, keys, "left").withColumn("_loss", loss).withColumn("_better", F.col("open") & better)
    best_step = F.when(F.col("_better"), step).otherwise(F.col("best_step"))
    ends = F.lit(step == steps) | (F.lit(step) - best_step >= (patience if step else steps + 1))
    return judged.select(
        *keys,
        "n",
        "n_val",
        F.when(F.col("open") & ~ends, moved).otherwise(F.col("weights")).alias("weights"),
        F.when(F.col("_better"), F.col("weights")).otherwise(F.col("best")).alias("best"),
        F.when(F.col("_better"), F.col("_loss")).otherwise(F.col("val_loss")).alias("val_loss"),
        best_step.cast("int").alias("best_step"),
        F.when(F.col("open"), step).otherwise(F.col("steps")).alias("steps"),
        (F.col("open") & ~ends).alias("open"),
    )


def predict(test: DataFrame, models: DataFrame, on: Sequence[str] = ("dataset_id",), slots: int | None = None) -> DataFrame:
    """(dataset_id, strategy, row_id, y_true, y_pred) of all test rows under every model of their dataset."""
    models = settle(models.select(*KEYS, "weights"), "models")
    width = slots or (models.select(F.size("weights")).first() or [1])[0] - 1
    rows = featurise(test.select("dataset_id", "row_id", "text", F.col("label").alias("y_true")), max(width, 1))
    return attach_settled(rows, models, list(on)).select(*KEYS, "row_id", "y_true", (margin() > 0).cast("int").alias("y_pred"))


def stored_models(spark: SparkSession, path: str) -> DataFrame | None:
    """The models under ``path``, None where none were stored."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def fit_missing(rows: DataFrame, path: str, **settings) -> DataFrame:
    """Fit the keys that have no model under ``path`` and append theirs; returns (dataset_id, strategy, skipped) of all keys of ``rows``.

    An append is committed as a whole, so an interrupted run leaves the models of earlier runs only. To fit a key anew, use another path.
    """
    spark = rows.sparkSession
    known = stored_models(spark, path)
    asked = rows.select(*KEYS).distinct()
    asked = settle(asked.withColumn("skipped", F.lit(False)) if known is None else _marked(asked, known), "asked")
    todo = attach(rows, asked.where("not skipped"), KEYS)
    if asked.where("not skipped").count():
        fit(todo.drop("skipped"), **settings).write.mode("append").parquet(path)
    return asked


def _marked(asked: DataFrame, known: DataFrame) -> DataFrame:
    return asked.join(known.select(*KEYS, F.lit(True).alias("skipped")), list(KEYS), "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))


def evaluate(test: DataFrame, path: str) -> DataFrame:
    """Fairness report of the stored models on the untouched test part."""
    models = stored_models(test.sparkSession, path)
    if models is None:
        raise ValueError(f"no models under {path}")
    return fairness_report(settle(predict(test, models), "predictions"))


