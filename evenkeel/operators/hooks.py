"""Hooks for models that are not part of this package. Spark hands them Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.constants import MAX_INPUT_TOKENS, PROMPT_PREFIX, PROMPT_SUFFIX
from evenkeel.functions.text import build_prompt, clean_generation, wrap_prompt

Generator = Callable[[DataFrame], DataFrame]


def batch_generator(
    load: Callable[[], Callable[[list[str], list[int]], list[str]]], prompt: Column | None = None
) -> Generator:
    """A generator from a model: ``load()`` runs once per task and returns ``fn(prompts, passes) -> texts``."""
    prompt = build_prompt(F.col("text")) if prompt is None else prompt

    def generate(samples: DataFrame) -> DataFrame:
        fields = {f.name: f.dataType.simpleString() for f in samples.schema}
        schema = ", ".join(f"`{n}` {t}" for n, t in fields.items())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for batch in batches:
                if len(batch) == 0:
                    continue
                model = model or load()
                texts = model(batch["_prompt"].tolist(), batch["pass"].tolist())
                yield batch.drop(columns="_prompt").assign(text=texts)

        raw = samples.withColumn("_prompt", prompt).mapInPandas(run, schema)
        return raw.withColumn("text", clean_generation(F.col("text")))

    return generate


def expression_generator(expression: Callable[[DataFrame], Column]) -> Generator:
    """A deterministic generator from a column expression."""

    def generate(samples: DataFrame) -> DataFrame:
        return samples.withColumn("text", clean_generation(expression(samples)))

    return generate


def pair_scorer(fn: Callable[[list[str], list[str]], list[float]]) -> Callable[..., DataFrame]:
    """A scorer from ``fn(paraphrases, originals) -> scores``, to be used wherever ``matching.matcher`` is."""

    @F.pandas_udf("double")
    def column(paraphrase: pd.Series, original: pd.Series) -> pd.Series:
        return pd.Series(fn(paraphrase.tolist(), original.tolist()), dtype="float64")

    def score(
        pairs: DataFrame, pair_id: Sequence[str], hypothesis: str = "paraphrase", reference: str = "original"
    ) -> DataFrame:
        return pairs.withColumn("score", column(F.col(hypothesis), F.col(reference)))

    return score


def tokenizer_hook(load: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Callable[[Column], Column]:
    """A sub-word tokenizer as an expression of type array<int>.

    ``load()`` runs once per task and returns ``fn(texts) -> ids`` for a batch; a null text has no ids.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for batch in batches:
            yield pd.Series(encode(batch.fillna("").tolist()), index=batch.index, dtype="object")

    return ids


def cut_prompt(
    load: Callable[[], tuple[Callable[[list[str]], list[list[int]]], Callable[[list[list[int]]], list[str]]]],
    max_tokens: int = MAX_INPUT_TOKENS,
) -> Callable[[Column], Column]:
    """Prompt whose text is cut to the budget by a sub-word tokenizer; shorter texts stay untouched, null is empty.

    ``load()`` runs once per task and returns ``encode(texts) -> ids`` and ``decode(ids) -> texts`` for a batch.
    """

    @F.pandas_udf("string")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, decode = load()
        budget = max(0, max_tokens - sum(map(len, encode([PROMPT_PREFIX, PROMPT_SUFFIX]))))
        for batch in batches:
            texts = batch.fillna("").tolist()
            ids = encode(texts)
            shortened = iter(decode([own[:budget] for own in ids if len(own) > budget]))
            fitted = [next(shortened) if len(own) > budget else text for own, text in zip(ids, texts, strict=True)]
            yield pd.Series(fitted, index=batch.index, dtype="object")

    return lambda text: wrap_prompt(cut(text))
