"""Labels, keys and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binarise_score(score: Column) -> Column:
    """-1 is negative (0), any other score is positive (1)."""
    return F.when(score == -1, 0).otherwise(1)


def binarise_rating(rating: Column) -> Column:
    """Ratings up to 2 are negative (0), the rest positive (1); 2.5 is positive."""
    return F.when(rating <= 2, 0).otherwise(1)


def is_opinion(rating: Column, text: Column) -> Column:
    """False for a missing or neutral (3) rating and for missing or empty text; blanks count as text."""
    return F.coalesce((rating != 3) & (F.length(text) > 0), F.lit(False))


def is_labelled(label: Column) -> Column:
    return label >= 0


def dataset_key(author: Column, name: Column) -> Column:
    return F.concat_ws("/", author, name)


def key_author(key: Column) -> Column:
    """The part before the first slash; null when the key is a bare name."""
    return F.when(F.contains(key, F.lit("/")), F.substring_index(key, "/", 1))


def key_name(key: Column) -> Column:
    """Everything after the first slash; the whole key when it is a bare name."""
    return F.when(F.contains(key, F.lit("/")), F.split(key, "/", 2)[1]).otherwise(key)


def paraphrase_id(pass_no: Column, src_id: Column) -> Column:
    return F.concat(F.lit("p"), pass_no.cast("string"), F.lit("_orig_"), src_id.cast("string"))


def paraphrase_pass(pid: Column) -> Column:
    return F.regexp_extract(pid, r"^p(\d+)_orig_(\d+)$", 1).cast("int")


def paraphrase_source(pid: Column) -> Column:
    return F.regexp_extract(pid, r"^p(\d+)_orig_(\d+)$", 2).cast("long")


def argmax_label(scores: Column) -> Column:
    """Index of the highest score; the first index wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


HASH_DOMAIN = (0, (1 << 60) - 1)


def hash_order(seed: int, *parts: Column) -> Column:
    """A reproducible pseudo-random order: the first 60 bits of md5('seed:part:..').

    Unlike rand(seed) it does not depend on how the rows are partitioned.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
