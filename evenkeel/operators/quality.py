"""Quality of generated text: validity, acceptance, scores over passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.constants import SCORE_THRESHOLD
from evenkeel.functions.text import content_of, content_overlap, is_valid_from, length_ratio, ws_tokens
from evenkeel.operators.bleu import bleu_of_counts, ngram_counts
from evenkeel.operators.ranking import row_positions
from evenkeel.workspace import settle

# Rows of an Arrow batch while texts are scored and counted; three Python workers can stand in a row there.
TEXT_ROWS = 400


def pair_by_position(
    paraphrases: DataFrame,
    originals: DataFrame,
    by: Sequence[str] = ("dataset_id",),
    order: str = "row_id",
    within: Sequence[str] = (),
) -> DataFrame:
    """Pair the i-th paraphrase of a dataset with its i-th original; the longer side is cut to the shorter.

    ``within`` names columns, such as the pass, in which paraphrases are counted apart; each of these series meets the same
    originals, which are counted once. Only ids are sorted and paired; the texts are joined to the paired ids.
    """
    by, series = list(by), [*by, *within]
    theirs_id = "_original_id"
    originals = originals.withColumnsRenamed({order: theirs_id, "text": "original"})
    ours = row_positions(paraphrases.select(*series, order), series, [order])
    theirs = row_positions(originals.select(*by, theirs_id), by, [theirs_id])
    paired = ours.join(theirs, [*by, "position"])
    with_ours = paraphrases.withColumnRenamed("text", "paraphrase").join(paired, [*series, order])
    return with_ours.join(originals.select(*by, theirs_id, "original"), [*by, theirs_id]).drop(theirs_id)


def paraphrase_features(pairs: DataFrame, paraphrase: str = "paraphrase", original: str = "original") -> DataFrame:
    """Add length ratio, content overlap and the verdict; each text is split only once."""
    tokens = pairs.select(
        "*", ws_tokens(F.col(paraphrase)).alias("_ours"), ws_tokens(F.col(original)).alias("_theirs")
    )
    measured = tokens.select(
        *pairs.columns,
        length_ratio(F.col("_ours"), F.col("_theirs")).alias("length_ratio"),
        content_overlap(content_of(F.col("_ours")), content_of(F.col("_theirs"))).alias("content_overlap"),
    )
    return measured.withColumn("is_valid", is_valid_from(F.col("length_ratio"), F.col("content_overlap")))


def keep_valid(pairs: DataFrame, paraphrase: str = "paraphrase", original: str = "original") -> DataFrame:
    return paraphrase_features(pairs, paraphrase, original).where("is_valid").select(*pairs.columns)


def acceptance_per_pass(
    scored: DataFrame,
    keys: Sequence[str] = ("dataset_id", "pass"),
    threshold: float = SCORE_THRESHOLD,
) -> DataFrame:
    """Pairs, accepted pairs, their rate and mean score; passes with fewer than two of either are left out."""
    accepted = F.col("score") >= threshold
    return (
        scored.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_total"),
            F.count(F.when(accepted, 1)).alias("n_accepted"),
            F.avg(F.when(accepted, F.col("score"))).alias("mean_score"),
        )
        .where((F.col("n_total") >= 2) & (F.col("n_accepted") >= 2))
        .withColumn("acceptance_rate", F.col("n_accepted") / F.col("n_total"))
    )


def pass_quality(
    scored: DataFrame,
    pair_id: Sequence[str],
    keys: Sequence[str] = ("dataset_id", "pass"),
    threshold: float = SCORE_THRESHOLD,
) -> DataFrame:
    """Acceptance per pass with the BLEU of the accepted pairs.

    The pairs are read once: what is written down per pair is its score and, if it is accepted, its n-gram counts, no texts.
    """
    keys = list(keys)
    accepted = F.col("score") >= threshold
    texts = [F.when(accepted, F.col(c)).alias(c) for c in ("paraphrase", "original")]
    counts = settle(ngram_counts(scored.select(*keys, "score", *texts), [*keys, "score"]), "scored", TEXT_ROWS)
    bleu = bleu_of_counts(counts.where(accepted), keys)
    return acceptance_per_pass(counts, keys, threshold).join(bleu.select(*keys, "bleu"), keys)


def quality_report(per_pass: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Mean and population standard deviation over passes."""
    return per_pass.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_passes"),
        F.round(F.avg("acceptance_rate"), 4).alias("acceptance_rate"),
        F.round(F.avg("mean_score"), 4).alias("score_mean"),
        F.round(F.stddev_pop("mean_score"), 4).alias("score_std"),
        F.round(F.avg("bleu"), 2).alias("bleu_mean"),
        F.round(F.stddev_pop("bleu"), 2).alias("bleu_std"),
    )
