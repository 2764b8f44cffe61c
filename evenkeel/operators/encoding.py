"""Text to fixed-length id arrays with a vocabulary that Spark learns from the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.constants import MAX_LENGTH
from evenkeel.functions.text import ws_tokens
from evenkeel.operators.joining import attach_settled
from evenkeel.operators.ranking import row_positions
from evenkeel.workspace import BROADCAST_ROWS, fits_broadcast, settle

PAD, UNKNOWN, FIRST_ID = 0, 1, 2


def learn_vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """Token ids by falling frequency over the whole texts, ties in token order; 0 pads and 1 is unknown."""
    counts = (
        df.select(F.explode(ws_tokens(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(0).alias("_all"), "token", "n", (-F.col("n")).alias("_order"))
    )
    ranked = row_positions(counts, ["_all"], ["_order", "token"], "_position")
    return ranked.select("token", "n", (F.col("_position") + FIRST_ID).cast("int").alias("token_id"))


def pad_ids(ids: Column, max_length: int = MAX_LENGTH) -> Column:
    """Cut to ``max_length`` and fill with the padding id."""
    cut = F.slice(ids, 1, max_length)
    return F.concat(cut, F.array_repeat(F.lit(PAD), max_length - F.size(cut)))


def attention_mask(ids: Column, max_length: int = MAX_LENGTH) -> Column:
    used = F.least(F.size(ids), F.lit(max_length))
    return F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), max_length - used))


def fixed_length(df: DataFrame, ids: str = "ids", max_length: int = MAX_LENGTH) -> DataFrame:
    """Replace an id array by ``input_ids`` and ``attention_mask`` of exactly ``max_length`` entries."""
    return (
        df.withColumn("input_ids", pad_ids(F.col(ids), max_length))
        .withColumn("attention_mask", attention_mask(F.col(ids), max_length))
        .drop(ids)
    )


def tiers(vocabulary: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The smallest ids of a settled vocabulary that may be broadcast, by measured rows and bytes, and the rest, if any.

    Ids of a learned vocabulary fall with frequency, so the first part serves nearly all tokens. Any other ids are right too.
    """
    if fits_broadcast(vocabulary, max_rows):
        return vocabulary, None
    bound = max_rows
    while True:
        near = F.coalesce(F.col("token_id").between(FIRST_ID, FIRST_ID + bound - 1), F.lit(False))
        head = vocabulary.where(near)
        if not bound or fits_broadcast(head, max_rows):
            return head, vocabulary.where(~near)
        bound //= 2


def encode_fixed(
    df: DataFrame,
    max_length: int = MAX_LENGTH,
    text: str = "text",
    vocabulary: DataFrame | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Replace the text by ``input_ids`` and ``attention_mask``; the other columns stay.

    Every row is encoded by itself, whatever ids it shares with others, as copies and paraphrases do: the rows are settled
    with a number of their own. The vocabulary is learned from the texts unless one (token, token_id) is given, as
    for a test part. Texts are never shuffled: frequent tokens get their ids where the text is, by broadcast. Of the other
    tokens one row per text and token, with its places, meets the rest of the vocabulary. Ids are put together by row number, at most
    ``max_length`` of a row, and the other columns join them there.
    """
    others = [c for c in df.columns if c != text]
    df = settle(df.withColumn("_row", F.monotonically_increasing_id()), "to-encode")
    vocabulary = learn_vocabulary(df, text) if vocabulary is None else vocabulary
    head, tail = tiers(settle(vocabulary.select("token", "token_id"), "vocabulary"), max_rows)
    tokens = df.select("_row", F.posexplode(F.slice(ws_tokens(F.col(text)), 1, max_length)).alias("_pos", "token"))
    coded = tokens.join(F.broadcast(head), "token", "left")
    known = F.coalesce("token_id", F.lit(UNKNOWN)).alias("_id")
    if tail is None:
        ids = coded.select("_row", "_pos", known)
    else:
        rare = coded.where("token_id is null").groupBy("_row", "token").agg(F.collect_list("_pos").alias("_places"))
        found = attach_settled(settle(rare, "rare-tokens"), settle(tail, "rare-vocabulary"), ["token"], "left", max_rows)
        ids = coded.where("token_id is not null").select("_row", "_pos", known)
        ids = ids.unionByName(found.select("_row", F.explode("_places").alias("_pos"), known))
    lists = ids.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_pos", "_id")))["_id"].alias("_ids"))
    encoded = df.select("_row", *others).join(lists, "_row", "left").drop("_row")
    return fixed_length(encoded.withColumn("_ids", F.coalesce("_ids", F.array().cast("array<int>"))), "_ids", max_length)


def feature_view(df: DataFrame) -> DataFrame:
    """The model's input columns, as far as they exist; ``label`` is called ``labels``."""
    renamed = df.withColumnRenamed("label", "labels")
    return renamed.select(*[c for c in ("input_ids", "attention_mask", "labels") if c in renamed.columns])
