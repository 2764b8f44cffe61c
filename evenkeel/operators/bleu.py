"""Corpus BLEU: order 4, no smoothing, clipped matches summed over the corpus, brevity penalty."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.constants import BLEU_ENTITIES, BLEU_ORDER, BLEU_REPLACEMENTS, BLEU_RULES

COUNTS = [f"{side}{n}" for side in ("m", "p", "r") for n in range(1, BLEU_ORDER + 1)]


class Tokenizer:
    """Token codes of texts, as ``functions.text.bleu_tokens`` splits them; a null text has none.

    Four replacements over every text take most of the time; here they cost a fraction of the JVM's. White space is what ``str.split`` takes.
    """

    def __init__(self):
        self.rules = [(re.compile(pattern), re.sub(r"\$(\d)", r"\\\1", template)) for pattern, template in BLEU_RULES]
        self.numbers: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        for old, new in BLEU_REPLACEMENTS + BLEU_ENTITIES:
            text = text.replace(old, new)
        for pattern, template in self.rules:
            text = pattern.sub(template, text)
        numbers = self.numbers
        return np.array([numbers.setdefault(word, len(numbers)) for word in text.split()], np.int64)


def pair_counts(ours: np.ndarray, theirs: np.ndarray) -> list[int]:
    """Clipped matches, hypothesis n-grams and reference n-grams of a pair, each by order.

    An n-gram is the number of its first n-1 tokens' gram together with the next token's code, numbered anew within the pair.
    """
    matches, grams, width = [], (ours, theirs), 1 + max(ours.max(initial=0), theirs.max(initial=0))
    for n in range(1, BLEU_ORDER + 1):
        if not len(grams[0]) or not len(grams[1]):
            matches += [0] * (BLEU_ORDER + 1 - n)
            break
        kinds, numbers = np.unique(np.concatenate(grams), return_inverse=True)
        a, b = numbers[: len(grams[0])], numbers[len(grams[0]) :]
        matches.append(int(np.minimum(np.bincount(a, minlength=len(kinds)), np.bincount(b, minlength=len(kinds))).sum()))
        # Numbers are below the pair's length and codes below the batch's distinct tokens, so the product fits a long.
        grams = (a[:-1].astype(np.int64) * width + ours[n:], b[:-1].astype(np.int64) * width + theirs[n:])
    sizes = [max(0, len(side) - n) for side in (ours, theirs) for n in range(BLEU_ORDER)]
    return matches + sizes


def ngram_counts(
    pairs: DataFrame, keys: Sequence[str], hypothesis: str = "paraphrase", reference: str = "original"
) -> DataFrame:
    """(keys.., m1..m4, p1..p4, r1..r4) of every pair: matches clipped within the pair, hypothesis and reference n-grams.

    Map-only: clipping concerns one pair, so its n-grams are counted where its texts are, and only the counts go on. A null text has none.
    """
    keys = list(keys)
    texts = pairs.select(*keys, F.col(hypothesis).alias("_ours"), F.col(reference).alias("_theirs"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, known, counts = Tokenizer(), {}, []
            for ours, theirs in zip(batch.column("_ours").to_pylist(), batch.column("_theirs").to_pylist()):
                if theirs not in known:  # pairs of one original mostly follow one another
                    known = {theirs: codes(theirs)}
                counts.append(pair_counts(codes(ours), known[theirs]))
            counts = np.array(counts, np.int64)
            columns = [pa.array(np.ascontiguousarray(counts[:, i])) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], [*keys, *COUNTS])

    schema = T.StructType([*[texts.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in COUNTS]])
    return texts.mapInArrow(run, schema)


def corpus_bleu(
    pairs: DataFrame,
    keys: Sequence[str],
    pair_id: Sequence[str] = (),
    hypothesis: str = "paraphrase",
    reference: str = "original",
) -> DataFrame:
    """``bleu`` times 100 per key. It is 0 as soon as one order has no match or the hypotheses are empty."""
    return bleu_of_counts(ngram_counts(pairs, keys, hypothesis, reference), keys)


def bleu_of_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS]).withColumnRenamed("r1", "reference_length")
    logs = sum(
        (F.log(F.col(f"m{n}") / F.col(f"p{n}")) for n in range(2, BLEU_ORDER + 1)),
        F.log(F.col("m1") / F.col("p1")),
    )
    brevity = F.when(F.col("p1") > F.col("reference_length"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("reference_length") / F.col("p1"))
    )
    all_match = F.least(*[F.col(f"m{n}") for n in range(1, BLEU_ORDER + 1)]) > 0
    return sums.select(
        *keys,
        F.when(all_match, 100 * brevity * F.exp(logs / BLEU_ORDER)).otherwise(F.lit(0.0)).alias("bleu"),
        F.col("p1").alias("hypothesis_length"),
        "reference_length",
    )
