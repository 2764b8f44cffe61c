"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

A document of z times its source's mean size is taken at the rate r(z) = U / (1 + (U - 1) exp(-lambda z)), U being the most
copies: of all rates between 0 and U that give a source its target number of words, those are the closest to 1 in
entropy. lambda is the dual variable of the source's word constraint; all sources' duals, which are convex, are solved together by
Newton steps kept inside a bracket. Each step is one aggregation over the distinct (source, size) pairs with their counts,
which give the same sums as the documents would.

Rates become copies by order sampling: every document has its rate's whole part, and the fraction's share goes to the
documents with the smallest u / fraction, u being a hash of id and text. The place of the cut is found per source
from two histograms, so no source is ever sorted or gathered. What one cut leaves open, because the next document is too
large, further cuts among smaller documents fill.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and share all words; a source at ``most`` times
its size keeps that, and the rest is shared again. Null texts have size 0. Documents of size 0 are taken once.
Rows with equal id and text share one decision. An empty table gives an empty result. The result depends on the rows
alone, not on their partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.operators.joining import attach_settled
from evenkeel.operators.ranking import row_positions
from evenkeel.workspace import fits_broadcast, settle

WEIGHTS = (5, 2, 1)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
STEPS = 60
TOLERANCE = 1e-9
BINS = 1024
CUTS = 4


def measured(docs: DataFrame, *kept: Column, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The columns in ``kept`` with _k (source as a key that is never null), _size in words and _u, a hash in [0, 1)."""
    return docs.select(
        *kept,
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_k"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        (F.xxhash64(F.col(doc_id), F.col(text)).bitwiseAND((1 << 53) - 1) / float(1 << 53)).alias("_u"),
    )


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """Settled sources (_k, source_size) with their ``target``."""
    placed = row_positions(sources.withColumn("_null", F.col("_k") == ""), [], ["_null", "_k"], "_at").drop("_null")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int"))
    weighed = settle(placed.withColumn("_w", weight.cast("double")).drop("_at"), "weights")
    cap = F.col("source_size") * float(most)
    total = float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, None
    while level != before:  # the level only rises, and with it the set of sources at their cap
        before, full = level, cap <= level * F.col("_w")
        capped, open_ = weighed.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_w")))).first()
        level = (total - (capped or 0.0)) / open_ if open_ else level
    return weighed.withColumn("target", F.least(cap, level * F.col("_w"))).drop("_w")


def rate(dual: Column, z: Column, most: int) -> Column:
    """Infinite duals stand for rates of 0 and ``most``."""
    return F.when(z == 0, 1.0).otherwise(most / (1 + (most - 1) * F.exp(-dual * z)))


def duals(sizes: DataFrame, sources: DataFrame, most: int = MOST, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """The sources with ``mean`` and ``dual``, from the counted sizes (_k, _size, n)."""
    fits = fits_broadcast(sources)
    share = F.try_divide("target", "source_size")
    start = F.when(F.col("source_size") == 0, 0.0).when(share >= most, math.inf).when(share <= 0, -math.inf)
    # As if every word lay in a document of the size that the average word lies in.
    start = start.otherwise(F.log(share * (most - 1) / (most - share)) * F.col("mean") * F.try_divide("source_size", "squares"))
    state = settle(
        sources.withColumn("mean", F.when(F.col("source_size") == 0, 1.0).otherwise(F.col("source_size") / F.col("docs")))
        .withColumn("dual", start)
        .withColumn("low", F.lit(-math.inf))
        .withColumn("high", F.lit(math.inf))
        .withColumn("done", F.abs("dual") == math.inf),
        "duals",
    )
    z = F.col("_size") / F.col("mean")
    r = rate(F.col("dual"), z, most)
    for _ in range(steps):
        if state.where(~F.col("done") & (F.col("source_size") > 0)).isEmpty():
            break
        open_ = sizes.where("_size > 0")
        joined = attach_settled(open_, state.where(~F.col("done")).select("_k", "mean", "dual"), ["_k"], fits=fits)
        sums = joined.groupBy("_k").agg(
            F.sum(F.col("n") * F.col("_size") * r).alias("f"),
            F.sum(F.col("n") * F.col("_size") * z * r * (1 - r / most)).alias("g"),
        )
        gap = F.col("f") - F.col("target")
        low, high = F.when(gap < 0, F.col("dual")).otherwise(F.col("low")), F.when(gap > 0, F.col("dual")).otherwise(F.col("high"))
        bound = F.greatest(F.lit(1.0), F.abs("dual"))
        newton = F.col("dual") - F.greatest(-bound, F.least(bound, gap / F.greatest(F.col("g"), F.lit(1e-300))))
        # A step that leaves the bracket, which is then finite on that side, is replaced by the bracket's middle.
        middle = F.when((F.col("low") > -math.inf) & (F.col("high") < math.inf), (F.col("low") + F.col("high")) / 2).otherwise(F.col("newton"))
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        step = (
            state.join(F.broadcast(sums) if fits else sums, "_k", "left")
            .withColumn("close", F.coalesce(F.abs(gap) <= tolerance * F.col("target"), F.lit(True)))
            .withColumn("newton", newton)
            .withColumn("low", low)
            .withColumn("high", high)
            .withColumn("dual", F.when(F.col("done") | F.col("close"), F.col("dual")).when(inside, F.col("newton")).otherwise(middle))
            .withColumn("done", F.col("done") | F.col("close"))
        )
        state = settle(step.select(*state.columns), "duals")
    return state.drop("low", "high", "done")


def order_of(u: Column, fraction: Column) -> Column:
    """u / fraction, brought into [0, 1) in the same order."""
    return u / (u + fraction)


def cut(rows: DataFrame, want: DataFrame, fits: bool) -> DataFrame:
    """(_k, edge, reached): in each source the rows (_k, _v, _size) with _v < edge have ``reached`` <= ``want`` words, and all but the next of a million steps would have more."""
    low, width, reached = F.lit(0.0), 1.0, F.lit(0)
    found = want.select("_k", "want", low.alias("edge"), reached.cast("long").alias("reached"))
    for _ in range(2):
        width /= BINS
        found = settle(found, "cut")
        inside = attach_settled(rows, found, ["_k"], fits=fits).where((F.col("_v") >= F.col("edge")) & (F.col("_v") < F.col("edge") + width * BINS))
        step = F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("edge")) / width).cast("int"))
        sums = inside.groupBy("_k", step.alias("step")).agg(F.sum("_size").alias("words"))
        # At most BINS rows per source.
        running = F.sum("words").over(Window.partitionBy("_k").orderBy("step"))
        taken = sums.withColumn("running", running).join(F.broadcast(found) if fits else found, "_k")
        over = F.col("reached") + F.col("running") > F.col("want")
        per = taken.groupBy("_k").agg(F.min(F.when(over, F.col("step"))).alias("first_over"), F.max(F.when(~over, F.col("running"))).alias("more"))
        joined = found.join(F.broadcast(per) if fits else per, "_k", "left")
        edge = F.col("edge") + F.coalesce(F.col("first_over"), F.lit(BINS)) * width
        found = joined.select("_k", "want", edge.alias("edge"), (F.col("reached") + F.coalesce("more", F.lit(0))).alias("reached"))
    return settle(found.drop("want"), "cut")


def fractional(rows: DataFrame, most: int) -> DataFrame:
    """Rows with their source's plan, with _base (whole part of the rate) and _v (order in which fractions are filled)."""
    r = rate(F.col("dual"), F.col("_size") / F.col("mean"), most)
    base = F.floor(r)
    return rows.withColumn("_base", base.cast("int")).withColumn("_v", F.when((r > base) & (F.col("_size") > 0), order_of(F.col("_u"), r - base)))


def filled(number: int) -> Column:
    """Whether one of the first ``number`` cuts has given the row the copy for its fraction."""
    chosen = F.lit(False)
    for i in range(number):
        chosen = chosen | ((F.col("_size") <= F.col(f"open{i}")) & (F.col("_v") < F.col(f"edge{i}")))
    return F.coalesce(chosen, F.lit(False))


def plan_mix(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, cuts: int = CUTS) -> DataFrame:
    """Per source (_k): source_size, target, mean, dual, and the edges of the cuts; from settled rows (_k, _size, _u)."""
    sizes = settle(rows.groupBy("_k", "_size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    words = F.col("_size") * F.col("n")
    sums = sizes.groupBy("_k").agg(F.sum(words).alias("source_size"), F.sum("n").alias("docs"), F.sum(words * F.col("_size").cast("double")).alias("squares"))
    sources = settle(targets(settle(sums, "sources"), weights, most), "targets")
    fits = fits_broadcast(sources)
    plan = duals(sizes, sources, most).drop("docs", "squares")
    whole = fractional(attach_settled(sizes, plan.withColumn("_u", F.lit(0.0)), ["_k"], fits=fits), most)
    whole = whole.groupBy("_k").agg(F.sum(F.col("_base") * F.col("_size") * F.col("n")).alias("whole"))
    want = F.floor(F.col("target") + 0.5) - F.col("whole")
    plan = settle(plan.join(whole, "_k").withColumn("open0", want).drop("whole"), "plan")
    for i in range(cuts):
        own = fractional(attach_settled(rows, plan, ["_k"], fits=fits), most)
        left = own.where(F.col("_v").isNotNull() & ~filled(i) & (F.col("_size") <= F.col(f"open{i}"))).select("_k", "_v", "_size")
        found = cut(left, plan.select("_k", F.col(f"open{i}").alias("want")), fits)
        joined = plan.join(F.broadcast(found) if fits else found, "_k")
        plan = settle(joined.withColumn(f"edge{i}", F.col("edge")).withColumn(f"open{i + 1}", F.col(f"open{i}") - F.col("reached")).drop("edge", "reached"), "plan")
    return plan


def apply_mix(rows: DataFrame, plan: DataFrame, most: int = MOST, cuts: int = CUTS) -> DataFrame:
    """Measured rows with ``source_size``, ``target`` and ``copies``; the plan is one settled row per source."""
    own = fractional(attach_settled(rows, plan, ["_k"]), most)
    copies = F.col("_base") + filled(cuts).cast("int")
    return own.select(*rows.columns, "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every row."""
    rows = settle(measured(docs, F.col(doc_id).alias("doc_id"), doc_id=doc_id, text=text, source=source), "measured")
    mixed = apply_mix(rows, plan_mix(rows, weights, most), most)
    return mixed.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "copies")


def repeat_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows as often as the mix takes them, with their own columns only."""
    rows = measured(docs, F.struct(*docs.columns).alias("_row"), doc_id=doc_id, text=text, source=source)
    plan = plan_mix(settle(rows.select("_k", "_size", "_u"), "measured"), weights, most)
    copied = apply_mix(rows, plan, most).where("copies > 0")
    return copied.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
