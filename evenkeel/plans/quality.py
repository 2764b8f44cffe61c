"""Quality report over a generation log."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evenkeel.constants import SCORE_THRESHOLD
from evenkeel.operators.joining import pair_by_id
from evenkeel.operators.quality import pair_by_position, pass_quality, quality_report

PAIR = ["dataset_id", "pass", "src_id"]


def report_on_log(log: DataFrame, originals: DataFrame, score, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Score every logged paraphrase against its original and sum up by dataset.

    ``originals``: dataset_id, src_id, text.
    """
    scored = score(pair_by_id(log, originals), PAIR)
    return quality_report(pass_quality(scored, PAIR, threshold=threshold))


def report_by_position(log: DataFrame, originals: DataFrame, score, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """The same for a log without usable ids: the i-th paraphrase of a pass is held against the i-th original of its dataset.

    Paraphrases are counted in each pass, originals once; what one side has more is left out.
    """
    pairs = pair_by_position(log, originals, order="src_id", within=["pass"])
    return quality_report(pass_quality(score(pairs, PAIR), PAIR, threshold=threshold))
