"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams, hashed to a fixed number of slots: single words, pairs of words, and runs of
one to three word shapes (runs of upper-case letters, lower-case letters and digits shortened to one sign each, other
signs as they are; a word equal to the one before it has a shape of its own). Each indicator is scaled by the
logarithm of the ratio of its smoothed counts in the two classes, and the scaled text is brought to length 1. A linear
model with hinge loss is fitted by dual coordinate descent: the sample is dealt into shards, each shard is one Spark
task, and the shards' weights are averaged. A logistic curve through the margins of rows that were kept out of the fit
turns a margin into a probability.

The sample is bounded: about ``rows_per_class`` labelled rows of each class, chosen by the hash of their key. Scoring reads
whole texts and has no bound. Rows whose label is neither 0 nor 1 teach nothing. An empty or null text has no feature
and so the probability at margin ``intercept``; without rows of both classes every score is the smoothed share of label 1.
Repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import CACHE_ENTRIES, list_rows, text_slices
from evenkeel.llm.language import sample_rows
from evenkeel.workspace import settle

SLOTS = 1 << 18
ROWS_PER_CLASS = 8_000
SHARDS = 8
#: One part in CALIBRATION of the sample draws the logistic curve and is kept out of the fit.
CALIBRATION = 5
REPEATED = np.uint64(0x9E3779B1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shape(word: bytes) -> str:
    """The word with its letters and digits shortened to signs, each run of one sign once."""
    signs = ["X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word.decode("utf-8", "replace")]
    return "".join(c for c, before in zip(signs, [None, *signs]) if c != before)


class Codes(dict):
    """Upper half: hash of the word, lower half: hash of its shape."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        code = self[word] = xxhash.xxh32_intdigest(word) << 32 | xxhash.xxh32_intdigest(shape(word))
        return code


def slots_of(texts: list[bytes | None], codes: Codes, slots: int) -> list[np.ndarray]:
    """The distinct slots of every text."""
    words = [(t or b"").split() for t in texts]
    flat = [w for own in words for w in own]
    both = np.fromiter(map(codes.__getitem__, flat), np.uint64, len(flat))
    word, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    out, start = [], 0
    for own in words:
        w, s = word[start : start + len(own)], form[start : start + len(own)].copy()
        start += len(own)
        s[1:][w[1:] == w[:-1]] = REPEATED
        grams = [w, w[:-1] * np.uint64(31) + w[1:] + np.uint64(1 << 40), s + np.uint64(2 << 40)]
        grams += [s[:-1] * np.uint64(37) + s[1:] + np.uint64(3 << 40), s[:-2] * np.uint64(1369) + s[1:-1] * np.uint64(37) + s[2:] + np.uint64(4 << 40)]
        out.append(np.unique((np.concatenate(grams) * MIX >> np.uint64(40)) % np.uint64(slots)).astype(np.int32))
    return out


@dataclass
class QualityModel:
    weights: np.ndarray  # per slot, with the naive Bayes ratio and the hinge-loss weight multiplied
    scale: np.ndarray  # squared naive Bayes ratio per slot, for the length of a text
    intercept: float
    slope: float
    shift: float

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        margins = np.array([self.weights[f].sum() / np.sqrt(self.scale[f].sum() + 1e-12) if len(f) else 0.0 for f in features]) + self.intercept
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def lists_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The integer lists of a column."""
    lists = column.combine_chunks()
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def descend(features: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """Weights (the last is the intercept) of the hinge-loss model, found by dual coordinate descent."""
    w, alpha, rng = np.zeros(len(ratio) + 1), np.zeros(len(y)), np.random.default_rng(seed)
    rows = []
    for f in features:
        x = ratio[f]
        rows.append((f, x / (np.sqrt((x * x).sum()) + 1e-6)))
    square = np.array([(x * x).sum() + 1.0 for _, x in rows])
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            f, x = rows[i]
            gradient = y[i] * (w[f] @ x + w[-1]) - 1
            step = min(max(alpha[i] - gradient / square[i], 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[f] += step * y[i] * x
                w[-1] += step * y[i]
    return w


def logistic(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve, with targets drawn in a little from 0 and 1."""
    positive, negative = weight[y > 0].sum(), weight[y <= 0].sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-12
        hessian = np.array([[(h * margins * margins).sum(), (h * margins).sum()], [(h * margins).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, np.array([(g * margins).sum(), g.sum()]))
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(
    rows: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    learn: Column | None = None,
    rows_per_class: int = ROWS_PER_CLASS,
    slots: int = SLOTS,
    shards: int = SHARDS,
    passes: int = 10,
    cost: float = 1.0,
    smoothing: float = 1.0,
) -> QualityModel:
    """Fit on the rows whose key has a label and that meet ``learn`` (a condition on the key)."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y in (0, 1)")
    if learn is not None:
        marked = marked.where(learn)
    # Bounded by rows_per_class, so it may be broadcast: the texts are not shuffled.
    chosen = settle(sample_rows(marked, "y", F.col("key"), rows_per_class, 2), "label-sample")
    sample = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")

    def extract(batches):
        codes = Codes()
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                features = slots_of(texts, codes, slots)
                lists = list_rows(pa.array(np.concatenate(features), pa.int32()), np.array([len(f) for f in features]))
                yield pa.RecordBatch.from_arrays([part.column("y"), part.column("h"), lists], ["y", "h", "f"])

    # The hash that chose the rows is of the key alone; this one is independent of it.
    hashed = sample.select("y", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(1 << 30)).alias("h"), "text")
    found = settle(hashed.mapInArrow(extract, "y int, h long, f array<int>"), "label-features")

    def tally(batches):
        counts = np.zeros((2, slots))
        for batch in batches:
            y, lists = batch.column("y").to_numpy(), batch.column("f")
            size = np.diff(lists.offsets.to_numpy())
            np.add.at(counts, (np.repeat(y, size), lists.flatten().to_numpy()), 1)
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[0, at]), pa.array(counts[1, at])], ["slot", "n0", "n1"])

    classes = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        odds = (classes.get(1, 0) + 1) / (classes.get(0, 0) + 1)
        return QualityModel(np.zeros(slots), np.ones(slots), 0.0, 1.0, float(np.log(odds)))
    kept = F.col("h") % CALIBRATION != 0
    summed = found.where(kept).mapInArrow(tally, "slot int, n0 double, n1 double").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = summed.toArrow()  # one row per slot at most
    counts = np.full((2, slots), smoothing)
    for row, name in enumerate(("n0", "n1")):
        counts[row, table["slot"].to_numpy()] += table[name].to_numpy()
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    total = sum(classes.values())
    balance = {y: total / (2 * n) for y, n in classes.items()}
    shared = rows.sparkSession.sparkContext.broadcast(ratio)

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("h")  # the same fit however the rows arrived
        y = rows["y"].to_numpy()
        w = descend(lists_of(rows["f"]), np.where(y > 0, 1.0, -1.0), shared.value, np.where(y > 0, cost * balance[1], cost * balance[0]), passes, rows["shard"][0].as_py())
        return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "n": pa.array([len(y)], pa.int64())})

    dealt = found.where(kept).withColumn("shard", (F.floor(F.col("h") / CALIBRATION) % shards).cast("int"))
    parts = dealt.groupBy("shard").applyInArrow(solve, "w binary, n long").collect()  # one row per shard
    w = sum(np.frombuffer(r["w"]) * r["n"] for r in parts) / max(1, sum(r["n"] for r in parts)) if parts else np.zeros(slots + 1)
    model = QualityModel(ratio * w[:-1], ratio * ratio, float(w[-1]), 1.0, 0.0)
    held = found.where(~kept).select("y", "f").toArrow()  # part of the bounded sample
    y = held["y"].to_numpy()
    if len(set(y.tolist())) == 2:
        features = lists_of(held["f"])
        margins = np.array([model.weights[f].sum() / np.sqrt(model.scale[f].sum() + 1e-12) if len(f) else 0.0 for f in features]) + model.intercept
        true = labelled_share(marked)
        weight = np.where(y > 0, true, 1 - true) * len(y) / np.where(y > 0, (y > 0).sum(), (y <= 0).sum())
        model.slope, model.shift = logistic(margins, y, weight)
    return model


def labelled_share(marked: DataFrame) -> float:
    return marked.agg(F.avg("y")).first()[0]


def score(rows: DataFrame, model: QualityModel, text: str = "text", name: str = "score", keep_text: bool = False) -> DataFrame:
    """Rows with the probability of label 1 (a column of that name is replaced), without their text unless it is to be kept."""
    shared, slots = rows.sparkSession.sparkContext.broadcast(model), len(model.weights)
    kept = [c for c in rows.columns if c != name and (keep_text or c != text)]
    whole = rows.select(*dict.fromkeys([*kept, text]))

    def run(batches):
        codes = Codes()
        for batch in batches:
            for part, texts in text_slices(batch, text):
                values = shared.value.scores(slots_of(texts, codes, slots))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(values, pa.float64())], [*kept, name])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema]
    return whole.mapInArrow(run, ", ".join([*fields, f"`{name}` double"]))
